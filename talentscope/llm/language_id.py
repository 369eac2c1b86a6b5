"""Operator 2: language identification by interpolated Kneser-Ney character models.

Per language the character 4-grams of all training texts are counted by Spark,
and every counted gram takes part, however many there are.  Lower orders hold
continuation counts (how many different characters a gram follows), each order
is discounted and interpolated with the next, and the unigrams with a uniform
distribution; counts, totals, discounts and probabilities are made by joins.

A gram is a 64-bit key of four 16-bit characters (characters beyond the basic
plane are hashed to 16 bits), so contexts and suffixes are shifts and masks.
A text's log-probability is a sum over its grams of all orders: the context's
back-off weight, and for a gram seen in the language what it has above its
back-off.  So the model is one sparse table of weights (language, gram), dealt
by hash into broadcast blocks of ``BLOCK_ROWS``, which add to a text's scores
one after the other; a task holds one block in memory.

Prediction: the language of the lowest cross-entropy per character; ties go to
the first name in order.  ``score`` is the posterior at ``SHARPNESS`` characters
of evidence.  ``rejected`` marks texts whose cross-entropy is above what all
but ``REJECT`` of the training texts of that language reach; the prediction
stays.  Text is lower-cased and everything but letters counts as one space.
Rows: NULL texts and texts without a letter get ``und`` and score 0, all texts
if there is nothing to learn from; the whole of a long text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, fold, saved

ORDER = 4
#: Weights of a broadcast block; numbers of a score matrix and grams held by a task at a time (none bounds the model).
BLOCK_ROWS, CELLS, HELD = 1 << 21, 1 << 23, 1 << 21
SHARPNESS, REJECT = 12.0, 0.001
COUNT_BATCH = 2_000_000
_LETTER: list = []


def characters(text: str | None) -> np.ndarray:
    """16-bit characters: letters, and one space for each run of anything else; three spaces lead, one ends."""
    if not text:
        return np.empty(0, np.uint64)
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(_LETTER[0][c], c, 32)
    c = c[(c != 32) | (np.r_[32, c[:-1]] != 32)]
    if not len(c) or (c == 32).all():
        return np.empty(0, np.uint64)
    c = c[:-1] if c[-1] == 32 else c
    c = np.where(c > 0xFFFF, 0xE000 + (c * 2654435761 >> 7) % 0x1900, c)  # the private area
    return np.concatenate([np.full(3, 32), c, [32]]).astype(np.uint64)


def grams(text: str | None) -> np.ndarray:
    c = characters(text)
    return (c[:-3] << np.uint64(48)) | (c[1:-2] << np.uint64(32)) | (c[2:-1] << np.uint64(16)) | c[3:] if len(c) else c


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    size = 0

    def out():
        for lang, parts in held.items():
            g, k = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(k.astype(np.int64))],
                                             names=["lang", "gram", "hits"])
        held.clear()

    for b in batches:
        for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
            g = grams(t.as_py())
            if len(g):
                held.setdefault(lang, []).append(g)
                size += len(g)
            if size >= COUNT_BATCH:
                yield from out()
                size = 0
    yield from out()


_LOW = [np.uint64((1 << 16 * k) - 1) for k in range(4)] + [np.uint64(0xFFFFFFFFFFFFFFFF)]


def _find(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array and whether the key is there."""
    if not len(keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return at, keys[at] == q


class KneserNey:
    """One language: per order sorted keys, discounted counts, and the contexts' totals and back-off weights."""

    def __init__(self, keys: np.ndarray, hits: np.ndarray, alphabet: int):
        self.alphabet, self.level = alphabet, {}
        for order in range(ORDER, 0, -1):
            once, twice = (hits == 1).sum(), (hits == 2).sum()
            discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
            ctx, inv = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inv, weights=hits), np.bincount(inv)
            self.level[order] = (keys, (hits - discount) / total[inv], ctx, discount * kinds / total)
            if order > 1:  # continuation counts: one for each character before the suffix
                keys, hits = np.unique(keys & _LOW[order - 1], return_counts=True)

    def backoff(self, order: int, contexts: np.ndarray) -> np.ndarray:
        _, _, ctx, weight = self.level[order]
        at, hit = _find(ctx, contexts)
        return np.where(hit, weight[at], 1.0)

    def probability(self, order: int, q: np.ndarray) -> np.ndarray:
        if not order:
            return np.full(len(q), 1.0 / self.alphabet)
        keys, p, _, _ = self.level[order]
        at, hit = _find(keys, q)
        return np.where(hit, p[at], 0.0) + self.backoff(order, q >> np.uint64(16)) * self.probability(order - 1, q & _LOW[order - 1])


def _lookup(rows: pa.Table) -> dict:
    """kind -> sorted keys, where each key's weights begin, their languages, the weights."""
    kind, key = rows["kind"].to_numpy(), rows["key"].to_numpy().view(np.uint64)
    lang, weight, out = rows["l"].to_numpy(), rows["weight"].to_numpy(), {}
    for k in np.unique(kind).tolist():
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(key[own], kind="stable")]
        keys, first = np.unique(key[own], return_index=True)
        out[k] = keys, np.append(first, len(own)), lang[own], weight[own]
    return out


class Model:
    """All languages: their names, the log-probability of a character under the uniform distribution, the blocks of weights."""

    def __init__(self, langs: list[str], uniform: float, blocks: list):
        self.langs, self.uniform, self.blocks = langs, uniform, blocks

    def _rows(self, block: dict, u: np.ndarray, order: int) -> np.ndarray:
        """Summed weights of ``order`` and below, a row for each of the grams ``u`` (sorted, ``order`` characters long)."""
        if order == 1:
            out = np.zeros((len(u), len(self.langs)))
        else:
            low, inv = np.unique(u & _LOW[order - 1], return_inverse=True)
            out = self._rows(block, low, order - 1)[inv]
        for kind, q in ((order, u), (ORDER + order, u >> np.uint64(16))):
            if kind in block:
                keys, first, lang, weight = block[kind]
                at, hit = _find(keys, q)
                at, hit = at[hit], np.flatnonzero(hit)
                k = first[at + 1] - first[at]
                of = np.arange(k.sum()) + np.repeat(first[at] - np.cumsum(k) + k, k)
                out[np.repeat(hit, k), lang[of]] += weight[of]
        return out

    def entropies(self, parts: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy per character, a row for each array of grams (none of them empty)."""
        n, langs = np.array([len(p) for p in parts]), len(self.langs)
        g, text, total = np.concatenate(parts), np.repeat(np.arange(len(parts)), n), np.zeros((len(parts), langs))
        step, slice_ = max(1, CELLS // langs), max(1, CELLS // 8 // langs)
        for shared in self.blocks:
            block = shared.value
            for i in range(0, len(g), step):
                u, inv = np.unique(g[i:i + step], return_inverse=True)
                rows = self._rows(block, u, ORDER)
                at = np.flatnonzero(rows.any(1)[inv])  # what this block knows something of
                for j in range(0, len(at), slice_):
                    some = at[j:j + slice_]
                    own = text[i + some]
                    edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    total[own[edge]] += np.add.reduceat(rows[inv[some]], edge, axis=0)
            if len(self.blocks) > 1:  # one block at a time in memory; the next use reads the local file again
                del block
                shared.__dict__.pop("_value", None)
        return -total / n[:, None] - self.uniform


def _low(order: int):
    return F.col("key").bitwiseAND(F.lit((1 << 16 * order) - 1))


def weights(counted: DataFrame) -> tuple[DataFrame, int]:
    """All counted grams (l, key, hits) as (l, kind, key, weight), and the size of the alphabet.

    Kind ``order``: what a gram seen in the language adds to the logarithm of
    what its back-off gives; kind ``ORDER + order``: the logarithm of a
    context's back-off weight.
    """
    levels = {ORDER: counted}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: one for each character before the suffix
        levels[order] = saved(levels[order + 1].groupBy("l", _low(order).alias("key")).agg(F.count("*").alias("hits")), f"language_grams_{order}")
    alphabet = levels[1].select("key").distinct().count() + 1
    grams = reduce(DataFrame.unionByName, [d.select("l", F.lit(o).alias("kind"), "key", "hits") for o, d in levels.items()])
    once, twice = F.count_if(F.col("hits") == 1), F.count_if(F.col("hits") == 2)
    share = F.greatest(F.least(once / (once + 2 * twice), F.lit(0.9)), F.lit(0.1))
    discount = saved(grams.groupBy("l", "kind").agg(F.when(once > 0, share).otherwise(0.5).alias("discount")), "language_discounts")
    ctx = F.shiftrightunsigned("key", 16).alias("ctx")
    contexts = grams.groupBy("l", "kind", ctx).agg(F.sum("hits").alias("total"), F.count("*").alias("kinds"))
    contexts = contexts.join(checked_broadcast(discount, 32), ["l", "kind"])
    contexts = saved(contexts.select("l", "kind", "ctx", "total", "discount", (F.col("discount") * F.col("kinds") / F.col("total")).alias("backoff")), "language_contexts")
    parts, lower = [contexts.select("l", (F.col("kind") + ORDER).alias("kind"), F.col("ctx").alias("key"), F.log("backoff").alias("weight"))], None
    for order in range(1, ORDER + 1):
        d = levels[order].withColumn("ctx", ctx).join(contexts.where(F.col("kind") == order).drop("kind"), ["l", "ctx"])
        if lower is None:
            d = d.withColumn("under", F.col("backoff") / alphabet)
        else:  # the suffix of a counted gram is counted
            d = d.withColumn("low", _low(order - 1)).join(lower.select("l", F.col("key").alias("low"), "p"), ["l", "low"])
            d = d.withColumn("under", F.col("backoff") * F.col("p"))
        seen = (F.col("hits") - F.col("discount")) / F.col("total")
        d = d.select("l", F.lit(order).alias("kind"), "key", (seen + F.col("under")).alias("p"), F.log1p(seen / F.col("under")).alias("weight"))
        lower = saved(d, f"language_probabilities_{order}") if order < ORDER else d
        parts.append(lower.drop("p"))
    return reduce(DataFrame.unionByName, parts), alphabet


def fit(labelled: DataFrame) -> Model:
    """``labelled``: (lang, text), no NULL lang."""
    spark = labelled.sparkSession
    counted = saved(labelled.select("lang", "text").mapInArrow(_count, "lang string, gram long, hits long").groupBy("lang", "gram").agg(F.sum("hits").alias("hits")), "language_grams")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not langs:
        return Model([], 0.0, [])
    names = spark.createDataFrame(list(enumerate(langs)), "l int, lang string")
    table, alphabet = weights(counted.join(F.broadcast(names), "lang").select("l", F.col("gram").alias("key"), "hits"))
    table = saved(table, "language_weights")
    n = -(-table.count() // BLOCK_ROWS)
    if n > 1:  # a file holds few blocks, so that reading one block skips the others' files
        table = table.withColumn("block", F.pmod(F.xxhash64("kind", "key"), F.lit(n)))
        table = saved(table.repartition(n, "block"), "language_blocks")
    blocks = [table.where(F.col("block") == i) if n > 1 else table for i in range(n)]
    return Model(langs, -float(np.log(alphabet)), [spark.sparkContext.broadcast(_lookup(b.select("l", "kind", "key", "weight").toArrow())) for b in blocks])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.langs
        texts = max(1, CELLS // max(len(names), 1))
        for b in batches:
            pred, score, cross, todo, size = ["und"] * b.num_rows, [0.0] * b.num_rows, [None] * b.num_rows, [], 0

            def flush():
                h = model.entropies([g for _, g in todo])
                best = h.argmin(1)
                odds = np.exp(-SHARPNESS * (h - h.min(1, keepdims=True))).sum(1)
                for (i, _), k, x, o in zip(todo, best.tolist(), h.min(1).tolist(), odds.tolist()):
                    pred[i], score[i], cross[i] = names[k], 1 / o, x
                todo.clear()

            for i, t in enumerate(b.column(1)):
                g = grams(t.as_py()) if names else ()
                if len(g):
                    todo.append((i, g))
                    size += len(g)
                if size >= HELD or len(todo) >= texts:
                    flush()
                    size = 0
            if todo:
                flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(cross, pa.float64())],
                                             names=["doc_id", "lang_pred", "score", "cross_entropy"])
    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy) per row; only ``text`` is looked at."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, cross_entropy double")


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) per row; fold 1 of 3 is held out of training."""
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    out = saved(predict(docs, fit(known)).withColumn("held_out", held_out), "language_scores")
    limit = out.where("not held_out and lang_pred <> 'und'").groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", 1 - REJECT, 10_000).alias("most"))
    out = out.join(F.broadcast(limit), "lang_pred", "left")  # a row per language of the model
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", F.coalesce(F.col("cross_entropy") > F.col("most"), F.lit(False)).alias("rejected"))
