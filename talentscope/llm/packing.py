"""Operator 3: sequence packing along a space-filling curve.

Every document becomes a vector by hashing its words; a fixed random
projection takes it to ``DIMENSIONS`` numbers (summed per word, so no wide
vector is ever built), each is squashed to a grid coordinate, and the Hilbert
index of the cell is the sort key.  Rows are range-partitioned and sorted by
(key, hash of the id), so neighbours on the curve meet in one task and copies
of one text, which share a key, are still split between tasks.  Each task
encodes its documents once and lays them end to end into sequences of
``capacity`` tokens, cutting a document where a sequence is full.  Only the
last stretch of a task does not fill a sequence; it is cut at powers of two,
which need no padding, so a packing has no padding at all.

Sequence ids are unique, not consecutive: the task's number times 2^32 plus a
running number.  Rows: NULL texts count as empty and consist of the end id
alone; NULL ids sort first and are packed like others; repeated rows are packed
once each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, shuffle_parts

DIMENSIONS, BITS = 4, 15
END_ID = 0


def project(hashes: np.ndarray) -> np.ndarray:
    """Projection of a document's hashed words: a word's row of the random
    matrix is four 16-bit parts of its hash; about unit variance at any length."""
    rows = hashes.astype("<u8").view("<i2").reshape(-1, DIMENSIONS)
    return rows.sum(axis=0, dtype=np.int64) / (32768 / 3 ** 0.5 * max(len(hashes), 1) ** 0.5)


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer points (rows; coordinates below 2^bits) on the Hilbert curve.

    Skilling's transform ("Programming the Hilbert curve", 2004), vectorised
    over points: undo the excess work from the high bit down, Gray-encode, then
    interleave the bits.
    """
    x = [c.copy() for c in cells.astype(np.uint64).T]
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        p = q - one
        for i in range(n):
            hit = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x0 = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ t)
            x[0] = x0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | (((x[i] ^ t) >> np.uint64(b)) & one)
    return out


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert key of each projected vector: normal quantiles spread the coordinates over the grid."""
    cells = np.clip((0.5 + 0.5 * np.tanh(0.8 * vectors)) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
    return hilbert_index(cells, BITS).astype(np.int64)


def with_curve_key(docs: DataFrame) -> DataFrame:
    """(doc_id, text, curve, salt): ``curve`` orders documents along the curve, ``salt`` splits equal keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHasher()
        for b in batches:
            v = np.array([project(words.of(t.as_py())) for t in b.column(1)]).reshape(-1, DIMENSIONS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(curve_keys(v))], names=["doc_id", "text", "curve"])
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, curve long")
    return keyed.withColumn("salt", F.xxhash64("doc_id"))


def pieces_of(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents laid end to end.

    Sequences take ``capacity`` tokens each; what is left at the end goes to
    sequences of falling powers of two.
    """
    total = sum(lengths)
    sizes = [capacity] * (total // capacity)
    rest = total % capacity
    sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    out, seq, used = [], 0, 0
    for doc, n in enumerate(lengths):
        at = 0
        while at < n:
            take = min(n - at, sizes[seq] - used)
            out.append((doc, at, take, seq, used))
            at, used = at + take, used + take
            if used == sizes[seq]:
                seq, used = seq + 1, 0
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_ENCODERS: dict = {}


def _rank_encoder(ranks_path: str, pattern: str):
    import tiktoken

    from .bpe import added_tokens, read_ranks

    if (ranks_path, pattern) not in _ENCODERS:
        _ENCODERS[ranks_path, pattern] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens=added_tokens(ranks_path))
    return _ENCODERS[ranks_path, pattern]


def _pack(ranks_path: str, pattern: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = _rank_encoder(ranks_path, pattern), TaskContext.get().partitionId()
        base, held, fill, pad = task << 32, [], 0, np.full(1, END_ID, "<u4")
        # held: documents (or their rests) not yet laid out: id, ids, tokens before, tokens in all

        def out(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        def lay(last: bool) -> list:
            nonlocal base, held, fill
            full = fill if last else fill // capacity * capacity
            lengths, left = [], full
            for _, ids, _, _ in held:
                lengths.append(min(left, len(ids)))
                left -= lengths[-1]
            rows = []
            for doc, at, take, seq, used in pieces_of(lengths, capacity):
                key, ids, before, n = held[doc]
                part = ids[at:at + take].tobytes()
                rows.append((key, before + at, take, zlib.crc32(part), n, base + seq, used, part if with_ids else None))
            if not last:
                base += full // capacity
                held = [(k, ids[m:], before + m, n) for (k, ids, before, n), m in zip(held, lengths) if m < len(ids)]
                fill -= full
            return rows

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode_to_numpy(t.as_py() or "", allowed_special="all").astype("<u4")
                held.append((key, np.concatenate([ids, pad]), 0, len(ids) + 1))
                fill += len(ids) + 1
                if fill >= 1 << 20:
                    yield out(lay(False))
            if fill >= capacity:
                yield out(lay(False))
        yield out(lay(True))
    return run


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on demand, the ids.

    ``ranks_path`` names the vocabulary; every document ends with ``END_ID``.
    The ids equal those of the ``tokenizers`` file of the same vocabulary, its
    added tokens included (tested); the rank encoder takes a quarter of its time.
    """
    keyed = with_curve_key(docs).repartitionByRange(shuffle_parts(docs.sparkSession), "curve", "salt").sortWithinPartitions("curve", "salt", "doc_id")
    out = keyed.select("doc_id", "text").mapInArrow(_pack(ranks_path, pattern, capacity, with_ids), _PIECES)
    return out if with_ids else out.drop("ids")
