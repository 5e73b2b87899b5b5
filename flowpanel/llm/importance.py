"""Importance resampling towards a target distribution.

Texts are lowered (ASCII only) and split by an untrained pre-tokenizer of the tokenizers library, a
Regex Split that returns words with offsets. Windows of consecutive offset pairs are the features;
each falls into a bucket by CRC-32. Corpus and target are compared by their bucket counts, which give
every bucket a gain. A document's weight is the mean gain of its features; the weight and Gumbel
noise hashed from the id make its score, and the highest scores are drawn.

A document is split once: its buckets are stored, counted over the whole corpus, and summed as gains
in a second pass. The gains are one number per bucket, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex, pre_tokenizers

from flowpanel.llm.common import cut, release, text_chunks
from flowpanel.llm.ordering import numbered

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
# Texts go to the pre-tokenizer in pieces that end at a separator, at least this many bytes long.
PIECE_BYTES = 2000
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024


def offsets(splitter: pre_tokenizers.Split, low: bytes) -> list[tuple[int, int]]:
    """Byte offsets (start, end) of the words of a lowered text."""
    out: list[tuple[int, int]] = []
    start = 0
    while start < len(low):
        cut_at = SEPARATOR.search(low, start + PIECE_BYTES)
        end = cut_at.start() if cut_at else len(low)
        piece = PreTokenizedString(low[start:end].decode())
        splitter.pre_tokenize(piece)
        out += [(start + a, start + b) for _, (a, b), _ in piece.get_splits("original", "byte")]
        start = end
    return out


def feature_buckets(low: bytes, at: list[tuple[int, int]], shortest: int, longest: int, buckets: int) -> np.ndarray:
    """The bucket of every run of `shortest` to `longest` consecutive words, joined by one space."""
    crc = zlib.crc32
    if shortest == longest == 1:
        found = [crc(low[a:b]) for a, b in at]
    else:
        found = []
        for i in range(len(at)):
            h = 0
            for n, (a, b) in enumerate(at[i : i + longest], 1):
                h = crc(low[a:b], crc(b" ", h) if n > 1 else 0)
                if n >= shortest:
                    found.append(h)
    return (np.array(found, dtype=np.uint32) % np.uint32(buckets)).astype("<u4")


def features(docs: DataFrame, id_col: str, text_col: str, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Rows (id, n_words, buckets): the bucket numbers of all features as 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
        for keys, own in text_chunks(batches, "k", "t"):
            words, found = [], []
            for t in own:
                low = t.lower()  # bytes: A-Z only
                at = offsets(splitter, low)
                words.append(len(at))
                found.append(feature_buckets(low, at, shortest, longest, buckets).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.int64()), pa.array(found, pa.binary())],
                                             names=["id", "n_words", "buckets"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.mapInArrow(run, "id bigint, n_words bigint, buckets binary")


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket; every task sends one count per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for z in b.column(0):
                total += np.bincount(np.frombuffer(z.as_buffer(), dtype="<u4"), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    counts = found.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, dtype=np.int64)
    for r in counts.collect():  # one row per bucket
        total[r["bucket"]] = r["n"]
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of (smoothed target share / smoothed corpus share)) per bucket."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((int(t) + 1) * (s_all + buckets) / ((int(s) + 1) * (t_all + buckets))))
        for s, t in zip(corpus, target, strict=True)], dtype=np.int64)


def noise(key: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the id; no id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(found: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score)."""
    shared = found.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            keys = b.column(0).to_pylist()
            sizes, weights = [], []
            for z in b.column(2):
                at = np.frombuffer(z.as_buffer(), dtype="<u4")
                sizes.append(len(at))
                weights.append(int(own[at].sum()) // len(at) if len(at) else 0)
            total = [w + noise(k, seed) for k, w in zip(keys, weights, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(v, pa.int64()) for v in (sizes, weights, total))],
                names=["doc_id", "n_words", "n_features", "weight", "score"])

    return found.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT,
             seed: int = SEED) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score, rank), one per document.

    Of the documents with at least `min_words` words `percent` % are drawn (rounded down); the rank
    of the others is null. Ties go to the smaller id, a null id stands last; rows that repeat an id
    are documents of their own and equal scores of theirs are ranked by weight and number of
    features. A null text has no words, no feature means weight 0. Empty tables: no documents give
    no rows, an empty target gives every bucket the gain of its corpus share alone. Other columns
    are ignored. Texts are read in pieces, so the memory of a task does not grow with the number of
    words of a text.
    """
    found = cut(features(docs, id_col, text_col, shortest, longest, buckets), "importance-features")
    wanted = features(target.withColumn("_no_id", F.lit(None).cast("bigint")), "_no_id", target_text, shortest, longest, buckets)
    gains = bucket_gains(histogram(found, buckets), histogram(wanted, buckets))
    scored = cut(scores(found, gains, seed), "importance-scores")
    release(found)
    enough = F.col("n_words") >= min_words
    drawn = scored.where(enough).count() * percent // 100
    order = [enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc()]
    ranked = numbered(scored, order, "rank", "importance-ranges")
    return ranked.withColumn("rank", F.when(enough & (F.col("rank") <= drawn), F.col("rank")))
