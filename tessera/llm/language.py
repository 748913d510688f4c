"""Language identification (operator 4) by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, pieces, small_batches, table

LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"
#: The fitted sample: per language at most so many documents, and so many bytes of each, which make the dictionary.
SAMPLE_DOCS = 64
DICT_BYTES = 64 * 1024
#: Of a sampled text no more characters come to the driver, twice what the whole dictionary holds.
SAMPLE_CHARS = 2 * DICT_BYTES
#: Whole texts are compressed in pieces of this size, so that the dictionary stays of use; below SHORT the carrier is put before them.
PIECE = 4096
SHORT = 256
LEVEL, SHORT_LEVEL = 5, 19
#: A margin is narrow if it is below those of all but this share of the labelled texts.
NARROW = 0.01

PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])


def plain(text: str) -> bytes:
    """Lower case, words of letters only, one space between and around them."""
    w = LETTERS.findall(text.lower())
    w = [p for x in w for p in ((x,) if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]  # numerals such as ½ aren't letters
    return (" " + " ".join(w) + " ").encode("utf-8", "ignore") if w else b""


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", used: set | None = None) -> dict[str, bytes]:
    """Dictionaries of the languages in ``docs``: their plain text from a sample of SAMPLE_DOCS documents a language.

    The sample is the bounded one of a classifier (SAMPLE_DOCS times SAMPLE_CHARS characters a language): ids fall into SAMPLE_DOCS bins by hash, and each language takes the id
    with the smallest hash from each bin. Rows without language or text don't count; with none left the result is empty.
    The ids of the sample are added to ``used``.
    """
    h = F.xxhash64(F.lit("sample"), F.col(key).cast("string"))
    d = docs.filter(F.col(lang).isNotNull() & (F.coalesce(F.length(text), F.lit(0)) > 0) & F.col(key).isNotNull())
    chosen = d.select(F.col(lang).alias("l"), F.col(key).alias("k"), h.alias("h")).groupBy("l", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("bin")).agg(F.min_by("k", "h").alias("k"), F.min("h").alias("h"))
    rows = chosen.collect()  # languages times SAMPLE_DOCS ids
    langs: dict[str, bytes] = {}
    if not rows:
        return langs
    got = d.filter(F.col(key).isin(sorted({r["k"] for r in rows}))).select(key, lang, F.substring(text, 1, SAMPLE_CHARS).alias("t"), h.alias("h")).collect()
    wanted = {(r["l"], r["k"]) for r in rows}
    if used is not None:
        used.update(r["k"] for r in rows)
    parts: dict[str, dict] = {}
    for r in sorted(got, key=lambda r: (r["h"], r["t"])):
        if (r[lang], r[key]) in wanted:
            parts.setdefault(r[lang], {}).setdefault(r[key], plain(r["t"]))
    for name, texts in parts.items():
        # each text gives an even share; what short ones leave goes to the longer ones
        left, share, n = DICT_BYTES, {}, len(texts)
        for i, (k, t) in enumerate(sorted(texts.items(), key=lambda x: len(x[1]))):
            share[k] = t[: left // (n - i)]
            left -= len(share[k])
        langs[name] = b"".join(share[k] for k in texts)
    return {k: v for k, v in sorted(langs.items()) if v}


class Classifier:
    """Chooses the language whose dictionary compresses a text to the fewest bytes; ties go to the first by name."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.long, self.short = {}, {}
        for name, raw in dictionaries.items():
            self.long[name] = self._compressor(raw, LEVEL)
            c, carrier = self._compressor(raw, SHORT_LEVEL), raw[-200:]
            self.short[name] = c, carrier, len(c(carrier))

    @staticmethod
    def _compressor(raw: bytes, level: int):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, x: bytes) -> dict[str, int]:
        if len(x) < SHORT:  # a lone short block would be stored as it is
            return {k: len(c(carrier + x)) - base for k, (c, carrier, base) in self.short.items()}
        cut = [x[i : i + PIECE] for i in range(0, len(x), PIECE)]
        if len(cut) > 1 and len(cut[-1]) < SHORT:
            cut[-2:] = [cut[-2] + cut[-1]]
        return {k: sum(len(c(p)) for p in cut) for k, c in self.long.items()}

    def predict(self, text: str | None, min_margin: float = 0.0) -> tuple[str, float, float, bool]:
        """``(language, score, margin, rejected)``; the margin is the share of bytes saved against the runner-up, the score 1 - (1 - margin)**10."""
        x = plain(text or "")
        if not x or not self.long:
            return UND, 0.0, 0.0, True
        sizes = self.sizes(x)
        order = sorted(sizes, key=lambda k: (sizes[k], k))
        if len(order) == 1:
            return order[0], 1.0, 1.0, False
        best, second = max(0, sizes[order[0]]), max(1, sizes[order[1]])
        margin = max(0.0, 1 - best / second)
        return order[0], min(1.0, 1 - (1 - margin) ** 10), margin, margin < min_margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.0, keep: DataFrame | None = None, rejected: str = "rejected") -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` of every row, from the whole text alone.

    ``und``, rejected, for null texts and texts without letters (and for all if nothing could be learned). Margins under
    ``min_margin`` are rejected, but keep their prediction. A map over Arrow batches, without a shuffle; the dictionaries
    (64 KB a language) travel with the function. Rows that repeat give rows that repeat; an empty table gives none.
    With ``keep``, a table that has ``text``, its rows are the input and keep all their columns; a column named by
    ``rejected`` is added, which must not be one of them, and only the texts travel to Python.
    """
    small_batches(docs.sparkSession)
    if keep is not None:

        @F.arrow_udf("boolean")
        def gone(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            c = Classifier(dictionaries)
            for a in texts:
                yield pa.array([c.predict(t.as_py(), min_margin)[3] for t in a], pa.bool_())

        return keep.withColumn(rejected, gone(F.col("text")))

    def run(batches):
        c = Classifier(dictionaries)
        for b in pieces(batches):
            found = [c.predict(t, min_margin) for t in b["text"].to_pylist()]
            yield batch(PREDICTED, [b["doc_id"], *([f[i] for f in found] for i in range(4))])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def learn(docs: DataFrame) -> tuple[dict[str, bytes], float]:
    """Dictionaries from the labelled rows of ``doc_id, text, lang`` that aren't held out, and the margin under which to reject.

    That is the NARROW quantile of the margins of all these rows with letters but the sample, to four digits, rounded
    down; 0 if no row is left. Margins are counted by value, so 10,001 rows at most come to the driver.
    """
    used: set = set()
    d = docs.select("doc_id", "text", "lang").filter(~held_out())
    found = fit(d, used=used)
    if not found:
        return found, 0.0
    rest = d.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~F.col("doc_id").isin(sorted(used)))
    counts = sorted(predict(rest, found).filter(F.col("lang_pred") != UND).groupBy(F.floor(F.col("margin") * 10000).alias("m")).count().collect())
    before, least = 0, NARROW * sum(n for _, n in counts)
    for m, n in counts:
        before += n
        if before > least:
            return found, m / 10000
    return found, 0.0


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that aren't held out, then predict every row: ``doc_id, held_out, lang_pred, score, margin, rejected``."""
    return predict(docs, *learn(docs)).withColumn("held_out", held_out())


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
