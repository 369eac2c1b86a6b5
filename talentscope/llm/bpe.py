"""Operator 9: byte-level BPE encoding and decoding, and the shared encoder.

The ``tokenizers`` library holds the vocabulary in characters: each byte is
written as one printable character (``byte_characters``) and the merges are
derived from the ranks (a token's last merge joins the two tokens that its
bytes reduce to under all earlier ranks).  Whole words found in the vocabulary
are taken at once, as the rank encoders do.

A text is cut before every white-space character that follows another kind of
character, if a single space stands there.  No match of the split pattern
crosses such a place and none looks past it from the left, so segments encode
alone exactly as within the text.  Segments repeat: a bounded table remembers
their ids and offsets, and each Arrow batch sends only the new ones to the
library.

Decoding maps each id back through the byte table.  A character that two
tokens share comes out whole again because bytes, not characters, are joined;
``decode`` returns bytes and ``decode_text`` the text, with U+FFFD for bytes
that are no UTF-8.  NULL texts count as empty; empty texts have no ids.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a task: Spark deals out the work

#: Unicode White_Space, which is ``\s`` of the tokenizers (Python's has four control characters more).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNSAFE = re.compile(f"[{_SPACE}] ")
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
_PLAIN = re.compile(f" [^{_SPACE}](?:.*[^{_SPACE}])?", re.S)


def byte_characters() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 stands for itself, the rest follows from U+0100."""
    shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def added_tokens(ranks_path: str) -> dict[str, int]:
    """Text and id of the tokens that the ``tokenizers`` file beside the ranks adds to them; they are whole wherever they stand."""
    path = os.path.splitext(ranks_path)[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or ()}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that ``token`` is merged from, or None if its bytes don't reduce to two."""
    parts, limit = [token[i:i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min(((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1)))
        if rank >= limit:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1])


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    show = lambda t: "".join(map(chars.__getitem__, t))
    merges = [m for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (m := last_merge(t, ranks))]
    tok = Tokenizer(models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=[(show(a), show(b)) for a, b in merges], ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


def tokenizer_from_file(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def segments(text: str) -> list[str]:
    """The text cut before single spaces that follow a non-space character."""
    if _UNSAFE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    out = [first] if first else []
    out += [" " + s for s in rest]
    return out


class Encoder:
    """Whole-text encoding by remembered segments."""

    def __init__(self, tok, limit: int = 250_000, offsets: bool = False):
        self.tok, self.limit, self.offsets = tok, limit, offsets
        self.ids: dict[str, bytes] = {}
        self.spans: dict[str, np.ndarray] = {}

    def _learn(self, new: list[str]) -> None:
        """Remember new segments.  Those that begin with a space and end without
        one encode alike when joined, so they go to the library as long texts and
        the offsets tell them apart; the others go one by one."""
        joined = [s for s in new if _PLAIN.fullmatch(s)]
        alone = set(new).difference(joined)
        parts = [joined[i:i + 4096] for i in range(0, len(joined), 4096)] + [[s] for s in alone]
        for i in range(0, len(parts), 64):
            some = parts[i:i + 64]
            for part, e in zip(some, self.tok.encode_batch(["".join(p) for p in some], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4").tobytes()
                spans = np.array(e.offsets, np.int64).reshape(-1, 2)
                at = np.cumsum([0, *map(len, part)])
                cut = np.searchsorted(spans[:, 0], at).tolist()
                cut[-1] = len(spans)
                for k, s in enumerate(part):
                    self.ids[s] = ids[4 * cut[k]:4 * cut[k + 1]]
                    if self.offsets:
                        self.spans[s] = spans[cut[k]:cut[k + 1]] - at[k]

    def batch(self, texts: list[str | None]) -> Iterator[tuple]:
        """Per text its ids (little-endian unsigned 32-bit) or, with offsets, (ids, array of [start, end) in characters)."""
        for i in range(0, len(texts), 512):
            cuts = [segments(t) if t else [] for t in texts[i:i + 512]]
            new = set().union(*cuts).difference(self.ids)
            if len(self.ids) + len(new) > self.limit:
                self.ids, self.spans, new = {}, {}, set().union(*cuts)
            self._learn(list(new))
            for cut in cuts:
                ids = b"".join(map(self.ids.__getitem__, cut))
                if not self.offsets:
                    yield ids
                elif not cut:
                    yield ids, np.empty((0, 2), np.int64)
                else:
                    spans = list(map(self.spans.__getitem__, cut))
                    base = np.cumsum([0, *map(len, cut[:-1])])
                    yield ids, np.concatenate(spans) + np.repeat(base, [len(x) for x in spans])[:, None]


class Decoder:
    """Ids back to bytes through the byte table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_text(self, ids: bytes) -> str:
        return self.decode(ids).decode("utf-8", "replace")


_CACHE: dict = {}


def _codec(path: str, pattern: str):
    """One tokenizer a Python worker and file."""
    if (path, pattern) not in _CACHE:
        ranks = read_ranks(path)
        _CACHE[path, pattern] = (tokenizer_from_ranks(ranks, pattern), Decoder(ranks))
    return _CACHE[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit, starts and ends: array<int> in characters)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(_codec(path, pattern)[0], offsets=True)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                got = list(enc.batch(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got], pa.binary()), *(pa.array([g[1][:, k].astype(np.int32) for g in got], pa.list_(pa.int32())) for k in (0, 1))],
                    names=["doc_id", "ids", "starts", "ends"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, content binary) from (doc_id, ids binary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = _codec(path, pattern)[1]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else dec.decode(x) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, digests only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, dec = _codec(path, pattern)
        enc = Encoder(tok)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            got = [(len(ids) // 4, sha(ids), sha(dec.decode(ids))) for ids in enc.batch(b.column(1).to_pylist())]
            n, a, d = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
