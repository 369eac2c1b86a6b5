"""Helpers shared by the operators: written intermediates, word hashing, ids."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentscope.session import write_and_read

#: Bytes of a join side that may be broadcast once its size has been counted.
BROADCAST_BYTES = 32 * 2**20

#: A word: a maximal run without ASCII white space (the same class in every operator).
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back."""
    return write_and_read(df, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def checked_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """``broadcast(df)`` if its counted rows stay under ``BROADCAST_BYTES``,
    else ``df`` itself, which Spark then joins by shuffle (AQE splits hot keys).
    ``df`` must be written or cheap to count."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of a text, all words at once.

    A word is a run of bytes without ASCII white space.  Its hash is a
    polynomial in P over random values of its bytes, read off a running sum
    and shifted to the word's start by a power of 1/P (P is odd, so it has an
    inverse modulo 2^64), then mixed with the length.  ``fold`` gives A-Z the
    values of a-z.  ``shapes`` hashes classes instead of bytes: runs of ASCII
    capitals, of other letters and of digits count once, symbols each.
    """

    BLOCK = 1 << 18
    P = 0x9E3779B97F4A7C1B  # 3 modulo 8: powers keep few common factors of two

    def __init__(self, fold: bool = False):
        values = np.frombuffer(xxhash.xxh3_128_digest(b"words") * 128, np.uint64)[:256] + np.arange(256, dtype=np.uint64)
        self.values = mix(values * np.uint64(0xD6E8FEB86659FD93))
        self.sep = np.zeros(256, bool)
        self.sep[[9, 10, 11, 12, 13, 32]] = True
        self.classes = np.arange(256)
        self.classes[128:] = ord("a")
        for run, name in (("abcdefghijklmnopqrstuvwxyz", "a"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), ("0123456789", "9")):
            self.classes[list(map(ord, run))] = ord(name)
        self.runs = np.isin(np.arange(256), list(map(ord, "aA9")))
        if fold:
            self.values[65:91] = self.values[97:123]
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, self.BLOCK + 1)
            one = np.ones(1, np.uint64)
            self.powers = np.cumprod(np.concatenate([one, np.full(size - 1, self.P, np.uint64)]))
            self.inverse = np.cumprod(np.concatenate([one, np.full(size - 1, pow(self.P, -1, 1 << 64), np.uint64)]))

    def _block(self, b: np.ndarray, shapes: bool) -> np.ndarray:
        sep = self.sep[b]
        edge = np.diff(np.concatenate([[True], sep, [True]]).view(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self._reach(len(b) + 1)
        if shapes:
            c = self.classes[b]
            keep = ~sep
            keep[1:] &= ~((c[1:] == c[:-1]) & self.runs[c[1:]])
            at = np.concatenate([[0], np.cumsum(keep)])
            b, start, stop = c[keep], at[start], at[stop]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[b] * self.powers[:len(b)])])
        return mix((total[stop] - total[start]) * self.inverse[start] + (stop - start).astype(np.uint64))

    def of(self, text: str | None, shapes: bool = False) -> np.ndarray:
        b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        if len(b) <= self.BLOCK:
            return self._block(b, shapes) if len(b) else np.empty(0, np.uint64)
        gaps, out, at = np.flatnonzero(self.sep[b]), [], 0
        while at < len(b):  # blocks end at white space
            k = int(np.searchsorted(gaps, at + self.BLOCK))
            stop = int(gaps[k]) if k < len(gaps) else len(b)
            out.append(self._block(b[at:stop], shapes))
            at = stop + 1
        return np.concatenate(out)
