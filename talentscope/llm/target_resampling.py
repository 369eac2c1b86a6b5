"""Operator 12: draw documents by a target distribution, ranked by a distributed radix sort.

Words are runs of ASCII letters and digits and of all characters beyond ASCII,
with A-Z lower-cased; the features are all runs of 1 to 3 consecutive words
joined by one space, counted into ``BUCKETS`` by the crc32 of their bytes.
Every document and every target text is counted in one scan; a bucket's gain
is a whole number, and a second scan sums the gains of each document.  No
string of a pair or triple is built: crc32 is linear over bits, so the
checksum of ``a b`` is that of ``a`` moved on by the length of the rest, which
is four table lookups an array of words.

The ranks come from an LSD radix sort over the digits of the composite key
(score descending, id ascending).  A pass is a stable counting sort: rows
stand in blocks of consecutive positions, counts per (digit, block) give each
block its global offset by prefix sums, and offset plus the row's place among
equal digits of its block is its destination, the next position.  Rows are
dealt by (block, digit), so no task gets more than one block for a key,
whatever the scores; each pass is written to the shared folder, and a lost
executor repeats its tasks from there.

Defined results: a NULL text has no features and weight 0; an empty text too.
A NULL id hashes as an empty id and comes after all others of its score.
Repeated rows are drawn one by one.  Texts are whole, however long; words of
any length count.  Without target texts the gains compare with an empty
target.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, saved, shuffle_parts

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 42, 20, 5
#: Bits of a digit and rows of a block at most (a block is what one key of a pass may hold).
DIGIT_BITS, BLOCK_ROWS = 12, 1 << 20
#: Bytes of a row of offsets in a broadcast table.
OFFSET_BYTES = 40
#: Distinct words remembered by a task, and bytes of text hashed at once.
REMEMBERED, AT_ONCE = 400_000, 1 << 18
#: Words of more bytes are hashed as strings.
LONG = 256

_MOD = np.uint32(BUCKETS)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _moves() -> np.ndarray:
    """[n, k, v]: the checksum with byte k equal to v, moved on by n bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    out = np.empty((LONG, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, LONG):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ one[out[n - 1] & np.uint32(0xFF)]
    return out


class Features:
    """Buckets of the word runs of texts, given as UTF-8 bytes."""

    def __init__(self):
        self.moves = _moves()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.arrays = (np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.int16))

    def _learn(self, new: list[bytes]) -> None:
        """Number new words and note their checksums, also with a space behind, and lengths."""
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new))))
        sums = list(map(zlib.crc32, new))
        spaced = self._step(np.array(sums, np.uint32))
        size = np.minimum(np.array(list(map(len, new)), np.int64), LONG - 1).astype(np.int16)
        if first + len(new) > len(self.arrays[0]):
            room = max(1 << 14, len(self.arrays[0]) + len(new))  # twice the room at least
            self.arrays = tuple(np.concatenate([a, np.empty(room, a.dtype)]) for a in self.arrays)
        for a, got in zip(self.arrays, (sums, spaced, size)):
            a[first:first + len(new)] = got

    def _step(self, c: np.ndarray) -> np.ndarray:
        """The checksum after one more space."""
        return (c >> np.uint32(8)) ^ self.moves[1, 0][c & np.uint32(255)] ^ np.uint32(zlib.crc32(b" "))

    def _move(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = self.moves.reshape(-1)
        at = n.astype(np.int64) * 1024
        return (m[at + (c & np.uint32(255))] ^ m[at + 256 + ((c >> np.uint32(8)) & np.uint32(255))]
                ^ m[at + 512 + ((c >> np.uint32(16)) & np.uint32(255))] ^ m[at + 768 + (c >> np.uint32(24))])

    def of(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(buckets of the words, pairs and triples of all texts one after the other, how many of each a text has)."""
        cut = [t.translate(_FOLD).split() if t else [] for t in texts]
        n = np.array(list(map(len, cut)), np.int64)
        every = list(itertools.chain.from_iterable(cut))
        try:
            at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        except KeyError:
            new = set(every).difference(self.known)
            if len(self.known) + len(new) > REMEMBERED:
                self.forget()
                new = set(every)
            self._learn(list(new))
            at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        sums, spaced, size = (a[at] for a in self.arrays)
        two = self._move(spaced[:-1], size[1:]) ^ sums[1:]
        three = self._move(self._step(two[:-1]), size[2:]) ^ sums[2:]
        for i in np.flatnonzero(size == LONG - 1):  # long words: from the strings
            if i > 0:
                two[i - 1] = zlib.crc32(b" ".join(every[i - 1:i + 1]))
            for j in (i - 1, i):
                if j > 0 and j + 1 < len(every):
                    three[j - 1] = zlib.crc32(b" ".join(every[j - 1:j + 2]))
        stop = np.cumsum(n)
        follows = np.ones(len(every), bool)  # the next word is of the same text
        follows[stop[n > 0] - 1] = False
        inside = follows[:-1]
        return [sums % _MOD, two[inside] % _MOD, three[inside[:-1] & inside[1:]] % _MOD], [n, np.maximum(n - 1, 0), np.maximum(n - 2, 0)]


def _parts(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, list]]:
    """(first row, texts) of slices of about ``AT_ONCE`` bytes; a text is never cut."""
    some, first, size = [], 0, 0
    for i, t in enumerate(b.column(column)):
        t = t.as_py()
        some.append(t)
        size += len(t or b"")
        if size >= AT_ONCE:
            yield first, some
            some, first, size = [], i + 1, 0
    if some:
        yield first, some


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum a task and bucket."""
    features, total = Features(), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, texts in _parts(b, 0):
            for k in features.of(texts)[0]:
                total += np.bincount(k, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of a table's ``text`` in each bucket (``BUCKETS`` numbers)."""
    sums = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole-number gain of each bucket: floor(1000 ln of the smoothed ratio of shares)."""
    s, t = float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + BUCKETS) / ((a + 1.0) * (t + BUCKETS)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def _weigh(gain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, values = Features(), gain.value
        for b in batches:
            for first, texts in _parts(b, 1):
                buckets, n = features.of(texts)
                weight = np.zeros(len(texts), np.int64)
                for k, m in zip(buckets, n):
                    total, stop = np.concatenate([[0], np.cumsum(values[k])]), np.cumsum(m)
                    weight += total[stop] - total[stop - m]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), pa.array(n[0]), pa.array(sum(n)), pa.array(weight)],
                    names=["doc_id", "n_words", "n_features", "weight"])
    return run


def weigh(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight) per row of ``docs``; ``target``: texts of the wanted distribution."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs), bucket_counts(target)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _weigh(gain), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int = SEED):
    """Gumbel noise fixed by the id, in thousandths: whole numbers, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _offsets(at: DataFrame) -> DataFrame:
    """(_digit, _block, _start): where the rows of a digit in a block begin, after all smaller digits and the digit's earlier blocks."""
    counts = at.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_n"))
    digits = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))  # one row a digit value
    before = digits.select("_digit", (F.sum("_all").over(Window.orderBy("_digit")) - F.col("_all")).alias("_base"))
    earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return counts.join(F.broadcast(before), "_digit").select("_digit", "_block", (F.col("_base") + F.col("_before")).alias("_start"))


def radix_ranks(rows: DataFrame, keys: list[tuple[str, int]], bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3 ...) in ascending order of the ``keys``.

    ``keys``: (whole-number column >= 0, its largest value), the most significant
    first.  ``rows`` has a unique ``slot`` (a monotonically increasing id that was
    written with it); rows of equal keys keep the order of their slots.
    """
    n = rows.count()
    parts = shuffle_parts(rows.sparkSession)
    size = max(1, min(block_rows, -(-n // (4 * parts))))
    at = rows.withColumn("_block", F.shiftright("slot", 33)).withColumnRenamed("slot", "_at")  # the first blocks: the tasks that wrote the rows
    digits = []  # (column, shift, width), the least significant first
    for column, most in reversed(keys):
        passes = -(-most.bit_length() // bits)
        width = -(-most.bit_length() // passes) if passes else 0
        digits += [(column, k * width, width) for k in range(passes)]
    blocks = n
    for column, shift, width in digits or [(keys[0][0], 0, 1)]:
        at = at.withColumn("_digit", F.shiftright(column, shift).bitwiseAND((1 << width) - 1))
        offsets = saved(_offsets(at), "radix_offsets")
        if min(n, blocks << width) * OFFSET_BYTES <= BROADCAST_BYTES:  # blocks x digits at most
            offsets = F.broadcast(offsets)
        place = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("_at")) - 1
        at = (at.withColumn("_place", place).join(offsets, ["_block", "_digit"]).withColumn("_at", F.col("_start") + F.col("_place"))
              .withColumn("_block", F.expr(f"_at div {size}L")).drop("_digit", "_start", "_place"))
        at, blocks = saved(at, "radix_pass"), -(-n // size)
    return at.withColumn("rank", F.col("_at") + 1).drop("_at", "_block")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) per row; ``rank`` is NULL for rows not drawn.

    Of the N rows with at least ``min_words`` words, the floor(percent * N / 100)
    of highest score are drawn, ties to the smaller id.
    """
    scored = weigh(docs, target).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = saved(scored.withColumn("slot", F.monotonically_increasing_id()), "resampling_scores")
    fit = scored.where(F.col("n_words") >= min_words)
    n, top, low, first, last = fit.agg(F.count(F.lit(1)), F.max("score"), F.min("score"), F.min("doc_id"), F.max("doc_id")).first()
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank"), "n_words")
    if not n:
        return rest
    first, last = first or 0, last or 0
    keyed = fit.select("slot", *columns, "n_words", (F.lit(top) - F.col("score")).alias("_down"), F.coalesce(F.col("doc_id") - F.lit(first), F.lit(last - first + 1)).alias("_up"))
    ranked = radix_ranks(keyed, [("_down", top - low), ("_up", last - first + 1)])
    k = percent * n // 100
    return ranked.select(*columns, F.when(F.col("rank") <= k, F.col("rank").cast("long")).alias("rank"), "n_words").unionByName(rest)
