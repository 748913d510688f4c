"""BPE encoding and decoding (operator 1) with a contiguous array of parts and ranks per word."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, pieces, small_batches, table

#: Words of more parts than this go to the heap variant, which doesn't rescan.
SHORT = 400
NONE = 1 << 60


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100 on."""
    out, extra = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Vocabulary:
    """A word-end BPE vocabulary read from a ``tokenizers`` JSON file.

    ``encode`` gives what that library's ``encode(text, add_special_tokens=False).ids`` gives; ``decode`` what its
    ``decode(ids, skip_special_tokens=False)`` gives for a file without decoder: tokens joined by one space.
    """

    def __init__(self, path: str, cache: int = 1 << 17):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (x, y) in enumerate(model["merges"]):
            self.rank.setdefault((self.ids[x], self.ids[y]), (r, self.ids[x + y]))
        self.letters = byte_letters()
        self.byte_id = [self.ids[self.letters[b]] for b in range(256)]
        self.last_id = [self.ids[self.letters[b] + self.end] for b in range(256)]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.cache, self.most = {}, cache

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter, so no final sigma
        return text.lower()  # runs of white space only separate words, which the pattern does as well

    def merge(self, word: str) -> list[int]:
        """Ids of one word. Parts and the ranks of neighbours lie in two plain lists; the leftmost smallest rank goes first."""
        raw = word.encode()
        parts = [self.byte_id[b] for b in raw]
        parts[-1] = self.last_id[raw[-1]]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        of = self.rank.get
        none = (NONE, -1)
        ranks = [of(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best[0] == NONE:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = of((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = of((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.rank[p], i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
        heap = [(r, i, new, p) for r, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, p = heapq.heappop(heap)
            j = after[i]
            if j >= n or (parts[i], parts[j]) != p:
                continue
            parts[i], parts[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (q := (parts[x], parts[y])) in self.rank:
                    r, made = self.rank[q]
                    heapq.heappush(heap, (r, x, made, q))
        return [p for p in parts if p >= 0]

    def _entry(self, word: str) -> tuple[int, str, str]:
        ids = self.merge(word)
        made = len(ids), " ".join(map(str, ids)), " ".join(self.names[i] for i in ids)
        if len(word) <= 64:
            if len(self.cache) >= self.most:
                self.cache.clear()
            self.cache[word] = made
        return made

    def entries(self, text: str) -> list[tuple[int, str, str]]:
        """Per word of the text: number of tokens, ids and decoded tokens, both joined by a space."""
        out, got = [], self.cache.get
        for k, piece in enumerate(self.cut(text)):
            if k % 2:
                out.append((1, str(self.special[piece]), piece))
            else:
                out += [got(w) or self._entry(w) for w in self.words(self.normal(piece))]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.entries(text or "") for i in ids.split(" ")]

    def decode(self, ids) -> str:
        return " ".join(self.names[i] for i in ids if i in self.names)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array of int) of each whole text; null text counts as empty, an empty table stays
    empty, rows that repeat stay, and a column that is named like the new one is replaced."""
    small_batches(docs.sparkSession)
    small_batches(docs.sparkSession)
    path = path or default_vocabulary()

    @F.pandas_udf("array<int>")
    def run(s):
        return s.map(lambda t: vocabulary(path).encode(t))

    return docs.withColumn(ids, run(F.coalesce(F.col(text), F.lit(""))))


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None, text: str = "decoded") -> DataFrame:
    """``docs`` with the text of a column of ids; ids outside the vocabulary are left out, null counts as no ids, an
    empty table stays empty, and a column that is named like the new one is replaced."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda x: vocabulary(path).decode([] if x is None else x))

    return docs.withColumn(text, run(F.col(ids)))


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_words", pa.int64())])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every whole text and keep counts and digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256, n_words``.

    Null and empty texts have no tokens and the digests of the empty string. Rows that repeat give rows that repeat.
    A map over Arrow batches without any shuffle: recovery from a lost executor recomputes only its own batches.
    """
    small_batches(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches):
        v = vocabulary(path)
        sha = hashlib.sha256
        for b in pieces(batches):
            rows = [[], [], [], [], []]
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = v.entries(text or "")
                n, ids, back = zip(*words, strict=True) if words else ((), (), ())
                for out, x in zip(rows, (doc, sum(n), sha(" ".join(ids).encode()).hexdigest(), sha(" ".join(back).encode()).hexdigest(), len(n)), strict=True):
                    out.append(x)
            yield batch(DIGESTS, rows)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_words long")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
