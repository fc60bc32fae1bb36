"""Token counts kept in a digest cache: only texts that the cache lacks are encoded."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.llm.common import scratch_path

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"

#: Words whose counts one Python worker keeps at most; beyond that it starts afresh.
_WORDS_KEPT = 1_000_000


def plainly_spaced(text: str) -> bool:
    """Single spaces and single line ends are all the white space there is, and none at the ends."""
    words = text.split()
    return len(" ".join(words)) == len(text) and text.count(" ") + text.count("\n") == len(words) - 1


class ByteLevelCounter:
    """Counts as the library gives them, with the counts of words remembered.

    The byte-level pattern always starts a token at a single space between two other characters, and
    makes a line end between two others a token of its own, so counts of words add up. Texts with other
    white space, or with the strings of special tokens, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.additive = '"use_regex":true' in self.tokenizer.to_str() and '"normalizer":null' in self.tokenizer.to_str()
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, known: dict[str, int], words, lead: str) -> None:
        distinct = set(words)
        missing = list(distinct - known.keys())
        if len(known) + len(missing) > _WORDS_KEPT:
            known.clear()
            missing = list(distinct)
        for word, enc in zip(missing, self.tokenizer.encode_batch_fast([lead + w for w in missing], add_special_tokens=False), strict=True):
            known[word] = len(enc.ids)

    def counts(self, texts: list[str]) -> list[int]:
        out, heads, tails, parts = [0] * len(texts), [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.additive or not plainly_spaced(text) or any(s in text for s in self.special):
                out[i] = self.whole(text)
                continue
            for line in text.split("\n"):
                words = line.split(" ")
                parts.append((i, words))
                heads.append(words[0])
                tails += words[1:]
        if parts:
            self._learn(self.first, heads, "")
            self._learn(self.later, tails, " ")
            newline, first, later = self.whole("\n"), self.first, self.later
            seen = -1
            for i, words in parts:
                out[i] += first[words[0]] + sum(map(later.__getitem__, words[1:])) + newline * (i == seen)
                seen = i
        return out


_COUNTERS: dict[str, ByteLevelCounter] = {}


def counter(path: str) -> ByteLevelCounter:
    if path not in _COUNTERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _COUNTERS[path] = ByteLevelCounter(path)
    return _COUNTERS[path]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            digests, texts = batch.column(0), batch.column(1)
            n_tokens, at = [], 0
            while at < len(texts):  # about a megabyte of text is held as Python strings at a time
                step = max(1, min(len(texts) - at, int((1 << 20) * len(texts) / max(1, texts.nbytes))))
                n_tokens += count.counts(texts.slice(at, step).to_pylist())
                at += step
            yield pa.RecordBatch.from_arrays([digests, pa.array(n_tokens, pa.int64())], names=["content_digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts; an absent or empty cache has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Tokens of every text, from stored counts where the same content was encoded by the same tokenizer before.

    Content is normalised by taking null as the empty text and by nothing else, since any other change could change
    the count. Its SHA-256 and that of the tokenizer file are the key. Distinct contents without a stored count are
    encoded once, by the task that holds the first row with them, and appended to the cache.
    A cache that holds a content more than once, as after two jobs at a time, counts it once. Empty and null texts have 0
    tokens. Repeated rows are counted each; null ids are carried through, and an empty
    table gives an empty table. Other columns of the input are ignored. Nothing is broadcast by request: hot contents
    are a skewed equi-join that adaptive execution splits, after an aggregate by digest with map-side combine.
    Result: id, n_bytes, n_tokens, over_limit.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-counts")
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content_digest"))
    known = read_cache(spark, cache_path).filter(F.col("tokenizer_digest") == version)
    # The first row of each content that is missing; ids and digests move, texts move once and only to be encoded.
    firsts = rows.groupBy("content_digest").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("first_id"))
    missing = firsts.join(known.select("content_digest"), "content_digest", "left_anti").withColumnRenamed("content_digest", "missing_digest")
    chosen = rows.join(missing.hint("shuffle_hash"), (F.coalesce("doc_id", F.lit(-1)) == F.col("first_id")) & (F.col("content_digest") == F.col("missing_digest")), "left_semi")
    encoded = chosen.select("content_digest", "text").mapInArrow(_encode(tokenizer_path), "content_digest binary, n_tokens long")
    fresh = encoded.groupBy("content_digest").agg(F.first("n_tokens").alias("n_tokens"))  # rows that repeat with their id
    fresh.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache_path)
    again = read_cache(spark, cache_path).filter(F.col("tokenizer_digest") == version)
    stored = again.groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))  # jobs may have appended the same content
    asked = rows.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return asked.join(stored, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
