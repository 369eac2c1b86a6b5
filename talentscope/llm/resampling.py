"""Operator 6: quality classifier by importance resampling.

Two bag-of-hashed-n-grams models are counted over whole texts: the target model
from the documents labelled good, the raw model from all documents.  N-grams:
words, word pairs, and pairs of word shapes (letter case, digits, symbols, and
whether the two words are equal), hashed into ``BUCKETS`` counts.  A document's
log weight is the mean log ratio of its n-grams times the square root of their
number, so long texts neither dominate nor drown.  Adding Gumbel noise, fixed by
the hashed id, and taking the k largest draws k documents without replacement
in proportion to their weights; k is the labelled share of good documents.

The k-th largest key is found exactly by narrowing a histogram of integer keys
(units of 2^-20), so no document list is sorted or gathered.  Rows: a NULL or
empty text has weight 1 (log weight 0); rows tied with the k-th key are all
kept; repeated rows share noise and fate; without labels every document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, checked_broadcast, mix, saved

BUCKETS, SMOOTHING, BINS = 1 << 16, 1.0, 4096
NOISE_SEED, UNIT = 6, 1 << 20


def buckets(text: str | None, words: WordHasher) -> np.ndarray:
    """Buckets of the n-grams of a whole text."""
    w, s = words.of(text), words.of(text, shapes=True)
    pair = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]
    kind = s[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + s[1:] + (w[:-1] == w[1:]).astype(np.uint64)
    return (mix(np.concatenate([w, pair + np.uint64(1), kind + np.uint64(2)])) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum per task and bucket, of all documents and of the good ones."""
    words, total = WordHasher(), np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        for good, t in zip(b.column(0).to_pylist(), b.column(1)):
            k = np.bincount(buckets(t.as_py(), words), minlength=BUCKETS)
            total[0] += k
            if good:
                total[1] += k
    some = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], names=["bucket", "raw", "target"])


def _weigh(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, log_ratio = WordHasher(), ratio.value
        for b in batches:
            out = []
            for t in b.column(1):
                k = buckets(t.as_py(), words)
                out.append(float(log_ratio[k].sum() / len(k) ** 0.5) if len(k) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "log_weight"])
    return run


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The exact k-th largest of a bigint column, by counting in ``BINS`` bins and narrowing to the bin that holds it."""
    lo, hi, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while lo < hi:
        width = -(-(hi - lo + 1) // BINS)
        inside = keys.where(F.col(column).between(lo, hi))
        bins = inside.groupBy(F.expr(f"({column} - ({lo}L)) div {width}L").alias("bin")).count().collect()  # BINS rows at most
        for b, c in sorted(bins, reverse=True):
            if k <= c:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= c
    return lo


def resample(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept) per row.  ``labelled``: (doc_id, quality), 1 is good."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = saved(labelled.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")), "resampling_labels")
    n = {r[0]: r[1] for r in marks.groupBy("quality").count().collect()}
    known = saved(marks.where("quality = 1").select("doc_id", F.lit(True).alias("good")), "resampling_good")
    good = docs.join(checked_broadcast(known, 32), "doc_id", "left").select("good", "text")
    sums = good.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    at = sums["bucket"].to_numpy()
    raw[at] += sums["raw"].to_numpy()
    target[at] += sums["target"].to_numpy()
    ratio = spark.sparkContext.broadcast(np.log(target / target.sum()) - np.log(raw / raw.sum()) if n.get(1) else np.zeros(BUCKETS))
    noise = -F.log(-F.log((F.pmod(F.xxhash64(F.lit(NOISE_SEED), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)))
    out = docs.mapInArrow(_weigh(ratio), "doc_id long, log_weight double")
    out = saved(out.withColumn("gumbel_key", F.round((F.col("log_weight") + noise) * UNIT).cast("long")), "resampling_keys")
    rows = out.count()
    k = round(rows * n.get(1, 0) / sum(n.values())) if n.get(1) else rows
    least = kth_largest(out, "gumbel_key", k)
    return out.withColumn("kept", F.col("gumbel_key") >= (0 if least is None else least))
