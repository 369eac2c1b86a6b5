"""Operator 1: token counts by offset-mapped attribution.

A document is encoded once as a whole; its tokens' character spans are then
joined with the spans of its sections (by default its lines) by binary search
over the sorted section starts, in the task that encoded it, so nothing is
shuffled.  Counting each section by itself would differ: tokens join across
section boundaries.

Allocation of a token that crosses a boundary: ``n_tokens`` gives it to the
section of its first character that is no ASCII white space (of its first
character if there is none); ``n_tokens_share`` splits it by characters.  Both
add up to the document's token count.  ``n_crossing`` counts the tokens with a
character in the section that also have one outside.

Spans: ``spans`` may name a column array<struct<name: string, start: int, end:
int>> of character spans that don't overlap; characters outside all spans form
the section NULL.  Rows: a NULL or empty text, or an empty or NULL span list,
gives one row without tokens or the section NULL alone; repeated rows are
counted each; a token that holds part of a character spans the character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "doc_id long, section int, name string, start long, end long, n_tokens long, n_tokens_share double, n_crossing long"
_ENCODERS: dict = {}


def rank_encoder(path: str, pattern: str):
    """The rank encoder and the byte length of each id; one a Python worker and file."""
    import tiktoken

    from .bpe import added_tokens, read_ranks

    if (path, pattern) not in _ENCODERS:
        ranks = read_ranks(path)
        added = added_tokens(path)
        size = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
        for token, rank in [*ranks.items(), *((t.encode("utf-8"), i) for t, i in added.items())]:
            size[rank] = len(token)
        _ENCODERS[path, pattern] = (tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added), size)
    return _ENCODERS[path, pattern]


def token_spans(text: str, encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first character, end, anchor) of the tokens; the anchor is what the allocation rule looks at."""
    enc, size = encoder
    ids = enc.encode_to_numpy(text, allowed_special="all")
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    stop = np.cumsum(size[ids])
    start = stop - size[ids]
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    at = np.where(blank, len(raw), np.arange(len(raw)))
    visible = np.minimum.accumulate(at[::-1])[::-1] if len(raw) else at  # next byte that is no white space
    anchor = np.where(visible[start] < stop, visible[start], start) if len(ids) else start
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return (ids, char[start], char[stop - 1] + 1, char[anchor]) if len(ids) else (ids, start, stop, anchor)


def line_sections(text: str) -> list[tuple[str | None, int, int]]:
    """The lines; a line ends after its line feed."""
    out, at = [], 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        out.append((None, at, at + len(line)))
        at += len(line)
    return out


def allocate(text: str, sections: list[tuple[str | None, int, int]], encoder) -> list[tuple]:
    """(section, name, start, end, n_tokens, n_tokens_share, n_crossing) per section, and the section NULL if it has tokens."""
    _, first, end, anchor = token_spans(text, encoder)
    spans = sorted((s for s in sections if s[1] < s[2]), key=lambda s: s[1])
    lo, hi = np.array([s[1] for s in spans], np.int64), np.array([s[2] for s in spans], np.int64)
    n = len(spans)
    own = np.searchsorted(lo, anchor, "right") - 1
    own = np.where((own >= 0) & (anchor < hi[own] if n else False), own, n)  # n: outside all spans
    whole = np.bincount(own, minlength=n + 1)
    share, crossing = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    a, b = np.searchsorted(lo, first, "right") - 1, np.searchsorted(lo, end - 1, "right") - 1
    inside = (a == b) & (a >= 0) & (end <= hi[a] if n else False)
    share += np.bincount(np.where(inside, a, n), weights=inside, minlength=n + 1)
    for t in np.flatnonzero(~inside).tolist():  # the few that cross a boundary or lie outside
        left = length = int(end[t] - first[t])
        touched = []
        for k in range(max(int(a[t]), 0), int(b[t]) + 1):
            both = min(int(end[t]), int(hi[k])) - max(int(first[t]), int(lo[k]))
            if both > 0:
                share[k] += both / length
                left -= both
                touched.append(k)
        if left:
            share[n] += left / length
            touched.append(n)
        if len(touched) > 1:
            crossing[touched] += 1
    out = [(k, s[0], s[1], s[2], int(whole[k]), float(share[k]), int(crossing[k])) for k, s in enumerate(spans)]
    if whole[n] or share[n] or not n:
        out.append((None, None, None, None, int(whole[n]), float(share[n]), int(crossing[n])))
    return out


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, spans: str | None = None) -> DataFrame:
    """One row per document and section (``_OUT``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(ranks_path, pattern)
        names = [x.split()[0] for x in _OUT.split(", ")]
        types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        for b in batches:
            rows: list = []
            for i, key in enumerate(b.column(0).to_pylist()):
                text = b.column(1)[i].as_py() or ""
                if spans:
                    sections = [(s["name"], s["start"], s["end"]) for s in b.column(2)[i].as_py() or [] if s and s["start"] is not None and s["end"] is not None]
                else:
                    sections = line_sections(text)
                rows += [(key, *r) for r in allocate(text, sections, encoder)]
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")] + ([F.col(spans).alias("spans")] if spans else [])
    return docs.select(*cols).mapInArrow(run, _OUT)
