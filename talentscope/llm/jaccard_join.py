"""Operator 7: n-gram Jaccard join by a blocked sparse matrix product.

Documents are rows and word n-grams are columns of a 0/1 incidence matrix A.
Two documents link when ``100 * |intersection| >= percent * |union|``; the
pairs are the entries of A x A^T above that bound.  The product is taken
column block by column block and never in full:

* **Equal rows first.** Documents with the same n-gram set are one node (a
  64-bit fingerprint of the sorted set), so copies are never paired.
* **Only columns that can matter.** Columns have one global order: frequent
  n-grams last (a bounded table of heavy columns, counted over all documents
  by lossy counting), then by hash.  A pair at the threshold must meet within
  the first ``n - ceil(t n) + 1`` columns of both rows, so only these entries
  are shuffled.  Any fixed order gives the same links; frequency merely keeps
  passages that many documents share out of the product.
* **Accumulated counts.** Overlap counts of pairs are summed over the columns.
  Columns beyond a row's prefix can add at most ``n - prefix`` to the overlap,
  so a pair whose count stays below ``required overlap - max(n - prefix)`` is
  discarded; what is left is verified on the whole sets.
* **Stars before pairs.** In each column every row is first counted with a few
  rows of a compatible size only, those of the lowest hash.  Verified pairs
  give a first set of components; a column whose rows are all in one component
  adds nothing more, and only pairs of *different* components are counted in
  full, as packed rows of the product.  Each round verifies a node's strongest
  partners and joins components, until no pair of two components is left that
  the bounds allow and nobody has verified.  The set of a star's centre is sent
  to as many places as the star has parts of ``STAR_PART`` members.

Links inside a component can't change it, so components are those of all
links.  Rows: a NULL or blank text has an empty set and links with nothing;
a text of fewer than ``width`` words has one n-gram, the whole sequence; equal
rows and ties give one node; NULL ids take no part and get a NULL component.
Fingerprints and n-gram hashes have 64 bits: at 10^9 different texts the
chance of one false equality is about 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, checked_broadcast, mix, saved, shuffle_parts

#: Slots of the table of heavy columns (one byte each) and the most columns entered.
LEVEL_SLOTS, HEAVY_COLUMNS, HEAVY_LEAST = 1 << 22, 1 << 17, 16
#: Centres of the stars in each run of compatible sizes of a column.
CENTRES = 2
#: Partners of a node that one round verifies, those of the highest counts; each further round takes eight times as many, until none is left.
FIRST_PARTNERS = 32
#: N-grams gathered before one lossy-counting step drops what it saw once.
COUNT_BATCH = 2_000_000
_MULT = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                                0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(text: str | None, width: int, words: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams, A-Z lower-cased."""
    h = words.of(text)
    n = len(h)
    if not n:
        return h
    w = min(width, n)
    out = np.full(n - w + 1, np.uint64(w if n < width else 0))
    for k in range(w):
        out += h[k:n - w + 1 + k] * _MULT[k % 8]
    return np.unique(mix(out))


def fingerprint(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else 0


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# ---- pass 1: one row per document, and the heavy columns ---------------------------------

_ROWS = "doc_id long, n long, node long, gram long, hits long"


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = WordHasher(fold=True), [], 0

        def counted():
            g, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64),) * 2
            g, c = g[c > 1], c[c > 1]
            none = pa.nulls(len(g), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))],
                                              names=["doc_id", "n", "node", "gram", "hits"])

        for b in batches:
            sizes, nodes = [], []
            for t in b.column(1):
                s = shingles(t.as_py(), width, words)
                sizes.append(len(s))
                nodes.append(fingerprint(s))
                held.append(s)
                size += len(s)
                if size >= COUNT_BATCH:
                    yield counted()
                    held, size = [], 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), none, none],
                                             names=["doc_id", "n", "node", "gram", "hits"])
        yield counted()
    return run


def _levels(heavy: list) -> np.ndarray:
    """One byte per slot: the binary logarithm of a heavy column's count, 0 for the rest."""
    table = np.zeros(LEVEL_SLOTS, np.uint8)
    if heavy:
        g = np.array([r[0] for r in heavy], np.int64).view(np.uint64)
        lv = np.log2(np.array([r[1] for r in heavy], float)).astype(np.uint8)
        np.maximum.at(table, (g & np.uint64(LEVEL_SLOTS - 1)).astype(np.int64), lv)
    return table


# ---- pass 2: prefix entries, grouped by column --------------------------------------------

def _entries(width: int, percent: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, levels = WordHasher(fold=True), set(), table.value
        for b in batches:
            gram, node, n = [], [], []
            for t in b.column(0):
                s = shingles(t.as_py(), width, words)
                if not len(s) or (f := fingerprint(s)) in seen:  # a copy in the same task adds nothing
                    continue
                if len(seen) < 1_000_000:
                    seen.add(f)
                p = prefix_length(len(s), percent)
                lv = levels[(s & np.uint64(LEVEL_SLOTS - 1)).astype(np.int64)]
                first = s[np.argsort(lv, kind="stable")[:p]]  # s is sorted by hash already
                gram.append(first)
                node.append(np.full(p, f, np.int64))
                n.append(np.full(p, len(s), np.int64))
            if gram:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gram).view(np.int64)), pa.array(np.concatenate(node)),
                                                  pa.array(np.concatenate(n))], names=["gram", "node", "n"])
    return run


def _by_column(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Runs of whole columns from batches sorted by (gram, n, node); a column may span batches."""
    held = None
    for b in batches:
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        held = [np.concatenate(x) for x in zip(held, new)] if held else new
        g = held[0]
        if len(g) and g[0] != g[-1]:
            cut = int(np.searchsorted(g, g[-1]))
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held and len(held[0]):
        yield held


def _spans(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return at, np.r_[at[1:], len(g)]


_STAR = "kind int, gram long, node long, n long, other long, other_n long, shared long"


def _stars(percent: int):
    """Rows of columns that more than one node is in (kind 0), and the overlap
    counts of nodes with the ``CENTRES`` nodes of the lowest hash among those of
    a compatible size (kind 1)."""
    names = [c.split()[0] for c in _STAR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}

        def counted() -> pa.RecordBatch:
            p = np.array([(*k, v) for k, v in acc.items()], np.int64).reshape(-1, 5)
            acc.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(p), np.int32)), pa.nulls(len(p), pa.int64()), *(pa.array(p[:, k]) for k in range(5))], names=names)

        for g, node, n in _by_column(batches, 3):
            keep = np.r_[True, (g[1:] != g[:-1]) | (node[1:] != node[:-1])]  # a node once per column
            g, node, n = g[keep], node[keep], n[keep]
            start, stop = _spans(g)
            many = stop - start > 1
            rows = list(zip(start[many].tolist(), stop[many].tolist()))
            for i, j in rows:
                at = i
                while at < j:  # a run of compatible sizes, ascending
                    stop = min(j, i + int(np.searchsorted(n[i:j], int(n[at]) * 100 // percent, "right")))
                    run_nodes, run_sizes = node[at:stop].tolist(), n[at:stop].tolist()
                    for c in np.argsort(node[at:stop], kind="stable")[:CENTRES].tolist():
                        centre, size = run_nodes[c], run_sizes[c]
                        for x, m in zip(run_nodes, run_sizes):
                            if x != centre:
                                k = (x, m, centre, size)
                                acc[k] = acc.get(k, 0) + 1
                    at = stop
            if rows:
                take = np.concatenate([np.arange(i, j) for i, j in rows])
                none = pa.nulls(len(take), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(take), np.int32)), pa.array(g[take]), pa.array(node[take]),
                                                  pa.array(n[take]), none, none, none], names=names)
            if len(acc) > 200_000:
                yield counted()
        if acc:
            yield counted()
    return run


#: A row of the product, or a part of it: the other nodes, their sizes and the overlap counts,
#: packed as little-endian 64-, 32- and 32-bit integers; or a pair that has been verified already.
_PRODUCT = "node long, n long, others binary, sizes binary, shared binary, tested long"
_PRODUCT_NAMES = [c.split()[0] for c in _PRODUCT.split(", ")]


def _need(n, m, percent: int):
    """Least intersection of sets of these sizes at the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def _products(percent: int):
    """This block of columns' part of the product's rows: for each node the nodes of
    larger components (by size, then label) that it shares columns with, so a
    column costs in proportion to the nodes that are not in its main component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        size = 0

        def rows() -> pa.RecordBatch:
            out = []
            for (x, n), parts in acc.items():
                other, at, shared = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
                sizes = np.concatenate([p[1] for p in parts])[at]
                out.append((x, n, other.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), shared.astype("<i4").tobytes()))
            acc.clear()
            cols = list(zip(*out)) if out else [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(out), pa.int64())], names=_PRODUCT_NAMES)

        for g, node, n, comp, members, most in _by_column(batches, 6):
            for i, j in zip(*map(np.ndarray.tolist, _spans(g))):
                if j - i < 2 or (comp[i:j] == comp[i]).all():
                    continue
                sizes, own, weight = n[i:j], comp[i:j], members[i:j]
                top = np.lexsort((own, weight))[-1]
                for x in np.flatnonzero(own != own[top]).tolist():  # sizes ascend
                    low = int(np.searchsorted(sizes, -(-percent * int(sizes[x]) // 100)))
                    high = int(np.searchsorted(sizes, int(sizes[x]) * 100 // percent, "right"))
                    larger = (weight[low:high] > weight[x]) | ((weight[low:high] == weight[x]) & (own[low:high] > own[x]))
                    y = i + low + np.flatnonzero(larger)
                    y = y[np.minimum(most[y], most[i + x]) >= _need(n[y], n[i + x], percent)]
                    if len(y):
                        acc.setdefault((int(node[i + x]), int(n[i + x])), []).append((node[y], n[y]))
                        size += len(y)
            if size > 1_000_000:
                yield rows()
                size = 0
        if acc:
            yield rows()
    return run


def _strongest(percent: int, k: int):
    """Whole product rows from their parts: of the pairs that the size bounds
    leave and nobody has verified, each node's ``k`` with the highest counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        out: list = []

        def close() -> None:
            parts = [r for r in held if r[5] is None]
            if not parts:
                return
            n = parts[0][1]
            every = np.concatenate([np.frombuffer(r[2], "<i8") for r in parts])
            other, at, inv = np.unique(every, return_index=True, return_inverse=True)
            shared = np.bincount(inv, weights=np.concatenate([np.frombuffer(r[4], "<i4") for r in parts])).astype(np.int64)
            m = np.concatenate([np.frombuffer(r[3], "<i4") for r in parts])[at].astype(np.int64)
            beyond = -(-percent * np.maximum(m, n) // 100) - 1  # the most that columns past the prefix can add
            ok = (shared >= _need(m, n, percent) - beyond) & ~np.isin(other, np.array([r[5] for r in held if r[5] is not None], np.int64))
            other, shared = other[ok], shared[ok]
            first = np.argsort(-shared, kind="stable")[:k]
            out.extend((held[0][0], o) for o in other[first].tolist())

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in (0, 1)], names=["node", "other"])
            out.clear()
            return b

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(6))):
                if held and held[0][0] != row[0]:
                    close()
                    held.clear()
                held.append(row)
            if len(out) >= 10_000:
                yield batch()
        if held:
            close()
        yield batch()
    return run


# ---- verification and components -----------------------------------------------------------

#: Members of a star that are verified in one place; a larger star is dealt to several.
STAR_PART = 64

_SETS = "node long, other long, part long, role int, grams binary"


def _sets(width: int):
    """The set of each text, once per task and place where it is needed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, last = WordHasher(fold=True), set(), (None, None)
        for b in batches:
            out: list = []
            for node, other, part, role, t in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4)):
                if last[0] != (node, t.as_py()):
                    s = shingles(t.as_py(), width, words)
                    last = ((node, t.as_py()), s.tobytes() if fingerprint(s) == node else None)  # an id may be repeated with another text
                if last[1] is not None and (node, other, part, role) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add((node, other, part, role))
                    out.append((node, other, part, role, last[1]))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                             names=["node", "other", "part", "role", "grams"])
    return run


def _verify(percent: int):
    """Members follow the set of their star's centre (role 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for b in batches:
            out = []
            for node, other, part, role, grams in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4)):
                if at != (other, part):
                    at, centre = (other, part), None
                if role == 0:
                    centre = np.frombuffer(grams.as_py(), np.uint64)
                elif centre is not None:
                    x = np.frombuffer(grams.as_py(), np.uint64)
                    both = np.intersect1d(x, centre, assume_unique=True).size
                    if 100 * both >= percent * (len(x) + len(centre) - both):
                        out.append((node, other))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["node", "other"])
    return run


def _linked(docs: DataFrame, rows: DataFrame, pairs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The pairs (node, other) whose whole sets reach the threshold, written.

    Pairs of one ``other`` form a star.  Its centre's set goes to every place
    that verifies ``STAR_PART`` of its members, so no star is one task's work.
    """
    size = pairs.groupBy("other").agg(F.ceil(F.count("*") / STAR_PART).alias("parts"))
    members = pairs.join(size, "other").select("node", "other", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.lit(1).alias("role"))
    members = saved(members, f"{name}_members")
    centres = members.select(F.col("other").alias("node"), "other", "part", F.lit(0).alias("role")).distinct()
    first = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    places = saved(members.union(centres).join(first, "node"), f"{name}_places")
    texts = docs.select("doc_id", "text").join(checked_broadcast(places, 64), "doc_id").select("node", "other", "part", "role", "text")
    sets = (texts.mapInArrow(_sets(width), _SETS).repartition(shuffle_parts(docs.sparkSession), "other", "part")
            .sortWithinPartitions("other", "part", "role"))
    return saved(sets.mapInArrow(_verify(percent), "node long, other long").distinct(), f"{name}_links")


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node reachable, by minimum labels and
    pointer jumping.  Each round is written, so a lost executor re-reads files."""
    edges = saved(links.select("node", "other").union(links.select("other", "node")).distinct().toDF("u", "v"), f"{name}_edges")
    label = saved(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")),
                  f"{name}_label0")
    step = 0
    while True:
        step += 1
        near = (edges.join(label.select(F.col("node").alias("v"), F.col("component").alias("c")), "v")
                .groupBy("u").agg(F.min("c").alias("m")))
        low = label.join(near, label.node == near.u).select("node", "component", F.least("component", "m").alias("c"))
        jump = low.join(label.select(F.col("node").alias("c"), F.col("component").alias("cc")), "c", "left")
        new = saved(jump.select("node", F.least("c", F.coalesce("cc", "c")).alias("component"), F.col("component").alias("before")),
                    f"{name}_label{step}")
        if new.where("component <> before").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies) for each row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.
    ``n_copies`` counts the documents with the same set, this one included.
    Links within a component that is already whole aren't verified, so there
    is no count of links.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = saved(docs.mapInArrow(_scan(width), _ROWS), "jaccard_scan")
    rows = scan.where("node is not null").select("doc_id", "n", "node")
    heavy = (scan.where("gram is not null").groupBy("gram").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= HEAVY_LEAST)
             .orderBy(F.desc("hits"), "gram").limit(HEAVY_COLUMNS))  # a bounded table, whatever the input
    table = spark.sparkContext.broadcast(_levels(heavy.collect()))

    entries = (docs.where("doc_id is not null").select("text").mapInArrow(_entries(width, percent, table), "gram long, node long, n long")
               .repartition(shuffle_parts(spark), "gram").sortWithinPartitions("gram", "n", "node"))
    star = saved(entries.mapInArrow(_stars(percent), _STAR), "jaccard_star")
    whole = rows.where("doc_id is not null")
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("other_n")) / (100 + percent))
    beyond = F.ceil(F.lit(percent) * F.greatest("n", "other_n") / 100) - 1  # the most that columns past the prefix can add

    def likely(counted: DataFrame) -> DataFrame:
        total = counted.groupBy("node", "n", "other", "other_n").agg(F.sum("shared").alias("shared"))
        return total.where(F.col("shared") >= need - beyond).select("node", "other")

    first = saved(likely(star.where("kind = 1")), "jaccard_first")
    tested = first.distinct()
    links = _linked(docs, whole, first, width, percent, "jaccard_0")
    comp = components(links, "jaccard_0")

    entries = star.where("kind = 0").select("gram", "node", "n")
    # columns of the prefix that nobody shares bound what a node can share with anyone
    most = saved(entries.groupBy("node", "n").agg(F.count("*").alias("seen")).select(
        "node", (F.ceil(F.lit(percent) * F.col("n") / 100) - 1 + F.col("seen")).cast("long").alias("most")), "jaccard_most")
    k, step = FIRST_PARTNERS, 0
    while True:
        step += 1
        known = comp.join(comp.groupBy("component").agg(F.count("*").alias("members")), "component")
        state = most.join(known, "node", "left").select(
            "node", "most", F.coalesce("component", "node").alias("component"), F.coalesce("members", F.lit(1)).alias("members"))
        block = (entries.join(state, "node").select("gram", "node", "n", "component", "members", "most")
                 .repartition(shuffle_parts(spark), "gram").sortWithinPartitions("gram", "n", "node"))
        none = F.lit(None)
        old = tested.union(tested.select("other", "node")).toDF("node", "other").select("node", none.cast("long").alias("n"), *[none.cast("binary").alias(c) for c in ("others", "sizes", "shared")], F.col("other").alias("tested"))
        rows_of = block.mapInArrow(_products(percent), _PRODUCT).union(old).repartition(shuffle_parts(spark), "node").sortWithinPartitions("node")
        rest = saved(rows_of.mapInArrow(_strongest(percent, k), "node long, other long"), f"jaccard_rest{step}")
        if rest.isEmpty():
            break
        found = _linked(docs, whole, rest, width, percent, f"jaccard_{step}")
        tested, k = tested.union(rest), 8 * k
        if not found.isEmpty():
            links = links.union(found)
            comp = components(links, f"jaccard_{step}")

    nodes = whole.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_copies"))
    nodes = nodes.join(comp, "node", "left").select("node", "low", "n_copies", F.coalesce("component", "node").alias("component"))
    nodes = saved(nodes, "jaccard_nodes")
    ids = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    nodes = nodes.join(ids, "component").select("node", "component_id", "n_copies")
    return rows.join(nodes, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("n_copies")).otherwise(F.lit(1)).alias("n_copies"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns;
    of rows that repeat such an id one stays.  Rows without an id stay."""
    rows = saved(jaccard_components(docs, width, percent).select("doc_id", "component_id"), "jaccard_rows").where("doc_id is not null")
    gone = saved(rows.where("doc_id <> component_id").select("doc_id").distinct(), "jaccard_gone")
    again = saved(rows.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard_again")
    stay = docs.join(checked_broadcast(gone, 16), "doc_id", "left_anti")
    if not again.isEmpty():
        twice = checked_broadcast(again, 16)
        stay = stay.join(twice, "doc_id", "left_anti").unionByName(stay.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return stay.select(*docs.columns)
