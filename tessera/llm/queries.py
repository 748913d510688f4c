"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, embeddings, exact, html, language, lines, mixing, simhash, suffix, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_language": language.op4_language,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_suffix_dedup": suffix.op6_suffix_dedup,
    "op7_warc": warc.op7_warc,
    "op8_html": html.op8_html,
    "op9_mixing": mixing.op9_mixing,
    "op10_embeddings": embeddings.op10_embeddings,
    "pipeline": pipeline,
}

ORACLES = {"op2_exact_dedup": exact.OP2_SQL, "op7_warc": warc.OP7_SQL, "op9_mixing": mixing.OP9_SQL}
