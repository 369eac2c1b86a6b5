"""Operator 11: spelling variants by finite-state composition.

Words are counted over whole texts (see ``occurrences``), and two words are near
if one inserted, deleted or replaced code point turns one into the other.  Near
words come from composing the minimised acceptor of the vocabulary with a
one-edit transducer and the acceptor again, one initial state at a time:

* Let ``m`` be the length of the shorter word of a pair and L the position of
  the edit, as far right as it can be (the length of the common prefix).  An
  initial state is a range [lo, hi] of L together with the text before and
  behind it; every word enters the states of its halves, as the shorter word
  (m is its length) or as the longer (m is one less).  All words of a near pair
  meet in exactly one state that accepts the pair, so no pair comes twice.
* A state with more than ``GROUP_ROWS`` words is replaced by the states of the
  two halves of its range, and so on to single positions.  What is left has at
  most an alphabet's words, so no prefix, however frequent, fills a task.
* In a task, each state builds minimal acceptors of its shorter and longer
  words over one register.  The composition walks them in step: equal labels
  without an edit, then two labels (replace) or one label of the longer
  (insert), then equal labels up to the end.  Equal states accept equal rests.

A word's form is its near word of largest count; the root follows forms by
pointer doubling (counts grow fivefold a step, so chains are short).

Defined results: a NULL text has no words; a NULL id hashes as an empty id;
repeated rows count again; ties go to the smaller word by code points; texts
and words of any length are whole.  An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentscope.session import broadcast_if_small

from .common import saved

LEAST_CHARS, LEAST_COUNT, RATIO, TYPO_EVERY = 6, 5, 5, 199
#: Words an initial state may hold before its range is halved, and words a task counts before it hands them on.
GROUP_ROWS, REMEMBERED = 20_000, 400_000
#: Near words collected before they are handed on.
AT_ONCE = 20_000

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_CHARS)
_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def occurrences(doc_id: int | None, text: str | None) -> dict[str, int]:
    """Counts of the words of a text: maximal runs of letters, A-Z lower-cased;
    a run whose checksum with the id is a multiple of ``TYPO_EVERY`` loses one code point."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes: A-Z alone
    runs = Counter(map(itemgetter(0), _RUN.finditer(low)) if len(low) > 1 << 22 else _RUN.findall(low))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lost = [(r, h % len(r), runs[r]) for r in runs if (h := zlib.crc32(r.encode(), start)) % TYPO_EVERY == 0]
    for run, _, _ in lost:
        del runs[run]
    for run, at, n in lost:  # once all are out: what a run becomes may be a run that loses one itself, and loses no more
        if len(run) > LEAST_CHARS:
            runs[run[:at] + run[at + 1:]] += n
    return runs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    hand_on = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=_WORDS)
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            for word, n in occurrences(doc_id, text.as_py()).items():
                total[word] += n
            if len(total) > REMEMBERED:
                yield hand_on()
                total = Counter()
    yield hand_on()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words with at least ``least`` occurrences."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ------------------------------------------------------------------ initial states

_STATE = ["m", "lo", "hi", "before", "behind"]


def _state_columns(rows: DataFrame) -> DataFrame:
    """The fixed texts before and behind the range [lo, hi], as the shorter word's length m sees them."""
    tail = F.greatest(F.col("m") - 1 - F.col("hi"), F.lit(0))
    return (rows.withColumn("before", F.substring("word", F.lit(1), F.col("lo")))
            .withColumn("behind", F.substring("word", F.length("word") - tail + 1, tail)))


def states(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, n, m, lo, hi, before, behind): each word in the initial states where a near word may stand."""
    size = F.length("word")
    lengths = F.filter(F.array(size, size - 1), lambda m: m >= LEAST_CHARS)
    ranges = lambda m, lo, cut, hi: F.array(*(F.struct(m.alias("m"), a.alias("lo"), b.alias("hi")) for a, b in ((lo, cut), (cut + 1, hi))))
    half = lambda m: (m / 2).cast("int") - 1
    new = _state_columns(words.select("word", "n", F.explode(F.flatten(F.transform(lengths, lambda m: ranges(m, F.lit(0), half(m), m)))).alias("s")).select("word", "n", "s.*"))
    done = None
    while True:
        full = saved(new.groupBy(*_STATE).count().where((F.col("count") > group_rows) & (F.col("lo") < F.col("hi"))).select(*_STATE), "spelling_full_states")
        if full.isEmpty():
            return new if done is None else done.unionByName(new)
        full = broadcast_if_small(full)
        fits = new.join(full, _STATE, "left_anti")
        done = fits if done is None else done.unionByName(fits)
        cut = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        new = new.join(full, _STATE, "left_semi").select("word", "n", F.explode(ranges(F.col("m"), F.col("lo"), cut, F.col("hi"))).alias("s")).select("word", "n", "s.*")
        new = saved(_state_columns(new), "spelling_states")


# ------------------------------------------------------------------ acceptors and composition

class Acceptor:
    """Minimal acceptors of word lists, each list of one length, over one register of states.

    A state is the dict label -> state of its arcs; states with equal arcs are
    the same, and the one without arcs is the end of every word.
    """

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.register: dict[tuple, int] = {}

    def _state(self, arcs: list[tuple[str, int]]) -> int:
        key = tuple(arcs)
        if key not in self.register:
            self.register[key] = len(self.arcs)
            self.arcs.append(dict(arcs))
        return self.register[key]

    def add(self, words: list[str]) -> int:
        """The initial state for sorted words of one length."""
        path: list[list[tuple[str, int]]] = [[]]
        last = ""

        def close(depth: int) -> None:  # the last word's states below ``depth`` get no more arcs
            while len(path) > depth + 1:
                s = self._state(path.pop())
                path[-1].append((last[len(path) - 1], s))
        for w in words:
            shared = len(commonprefix([last, w]))
            close(shared)
            path.extend([] for _ in range(len(w) - shared))
            last = w
        close(0)
        return self._state(path[0])

    def common(self, p: int, q: int, start: str, other: str, but: str = "") -> Iterator[tuple[str, str]]:
        """Both words for every rest that states p and q accept; ``but``: no rest begins with it."""
        stack = [(p, q, None)]
        while stack:
            p, q, chain = stack.pop()
            a, b = self.arcs[p], self.arcs[q]
            if not a and not b:
                rest = _text(chain)
                yield start + rest, other + rest
            for c in a.keys() & b.keys() if p != q else a:
                if chain or c != but:
                    stack.append((a[c], b[c], (chain, c)))

    def replaced(self, s: int) -> Iterator[tuple[str, str]]:
        """Pairs of words from state s that differ in one label."""
        stack = [(s, None)]
        while stack:
            s, chain = stack.pop()
            arcs = self.arcs[s]
            if len(arcs) > 1:
                labels, before = sorted(arcs), _text(chain)
                for i, x in enumerate(labels):
                    for y in labels[i + 1:]:
                        yield from self.common(arcs[x], arcs[y], before + x, before + y)
            stack.extend((t, (chain, c)) for c, t in arcs.items())

    def inserted(self, s: int, t: int, reach: int) -> Iterator[tuple[str, str]]:
        """Pairs of a word from s and one from t that has one label more, at position ``reach`` at most."""
        stack = [(s, t, None, 0)]
        while stack:
            s, t, chain, depth = stack.pop()
            short, long = self.arcs[s], self.arcs[t]
            before = None
            for c, q in long.items():
                if not short or short.keys() & self.arcs[q].keys():
                    before = _text(chain) if before is None else before
                    yield from self.common(s, q, before, before + c, but=c)  # else the edit stands further right
            if depth < reach:
                stack.extend((short[c], long[c], (chain, c), depth + 1) for c in short.keys() & long.keys())


def _text(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, c = chain
        out.append(c)
    return "".join(reversed(out))


def near_words(m: int, lo: int, hi: int, words: list[str]) -> Iterator[tuple[str, str]]:
    """Near pairs of the words of an initial state whose edit is in [lo, hi]."""
    tail = max(m - 1 - hi, 0)
    middle: dict[int, list[str]] = {m: [], m + 1: []}
    for w in words:
        middle[len(w)].append(w[lo:len(w) - tail])
    short, long = (sorted(middle[k]) for k in (m, m + 1))
    if not short or len(short) + len(long) < 2:
        return
    same = len(commonprefix([short[0], short[-1], *long[:1], *long[-1:]]))
    before, behind = words[0][:lo] + short[0][:same], words[0][len(words[0]) - tail:]
    automaton = Acceptor()
    s = automaton.add([w[same:] for w in short])
    for x, y in automaton.replaced(s):
        yield before + x + behind, before + y + behind
    if long and same <= hi - lo:  # else every pair of the two lengths agrees beyond the range
        for x, y in automaton.inserted(s, automaton.add([w[same:] for w in long]), hi - lo - same):
            yield before + x + behind, before + y + behind


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))
    out: list[tuple] = []
    for state, group in groupby(rows(), itemgetter(0, 1, 2, 3, 4)):
        n = {r[5]: r[6] for r in group}
        if len(n) > 1:
            for x, y in near_words(*state[:3], list(n)):
                out += ((x, n[x], y, n[y]), (y, n[y], x, n[x]))
                if len(out) >= AT_ONCE:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), schema=_NEAR)
                    out = []
    if out:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), schema=_NEAR)


def near_pairs(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, n, near, near_n): every near pair in both directions.  ``words``: distinct (word, n), written."""
    at = states(words, group_rows).repartition(*_STATE).sortWithinPartitions(*_STATE)
    return at.select(*_STATE, "word", "n").mapInArrow(_compose, "word string, n long, near string, near_n long")


# ------------------------------------------------------------------ forms and roots

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms followed to the last, twice as far each round."""
    at = saved(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        on = broadcast_if_small(at.select(F.col("word").alias("root"), F.col("root").alias("further")))
        step = saved(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling_roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, least: int = LEAST_COUNT, ratio: int = RATIO, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of ``docs`` (doc_id, text)."""
    words = saved(vocabulary(docs, least), "spelling_words")
    none = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))))
    forms = none.unionByName(near_pairs(words, group_rows)).groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    kept = F.col("best.less") <= -F.lit(ratio) * F.col("n")
    forms = saved(forms.select("word", "n", "n_near", F.when(kept, F.col("best.form")).alias("form"), F.when(kept, -F.col("best.less")).alias("form_n")), "spelling_forms")
    return (forms.join(broadcast_if_small(roots(forms)), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
