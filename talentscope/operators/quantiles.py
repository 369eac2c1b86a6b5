"""Exact quantiles of groups, with a bounded state per group.

``percentile`` and ``median`` keep every distinct value of a group in one
task.  Here the wanted ranks of all groups are narrowed together: a rank
starts in the open interval of all values of its group; an approximate
quantile grid of the interval (a sketch of fixed size) proposes two cuts
around it, one aggregate counts exactly how many values lie below and at
each cut, and either a cut is the answer or the rank goes on in a smaller
open interval.  Ties leave with their cut, so a value that fills most of a
group ends the search instead of stalling it.  Intervals of at most ``leaf``
values are read out and sorted.

Every pass is a scan with map-side combined aggregates over the groups
(joined to their state, one row a group, broadcast when measured small), so
neither a group holding the whole table nor a column of distinct doubles
meets in one task.  A pass divides the interval by about ``GRID`` / 4.  The
state is written between passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentscope.session import attach_one_row, broadcast_if_small, write_and_read

#: Values of an interval that may be read out in one row, points of the grid, and the sketch's accuracy.
LEAF, GRID, ACCURACY = 50_000, 200, 4_000


def _with_state(values: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Every value beside its group's state."""
    if not keys:
        return attach_one_row(values, state)
    named = broadcast_if_small(state.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in state.columns if c not in keys]))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return values.join(named, same).drop(*[f"_k_{k}" for k in keys])


def _inside(x: Column, j: int, prefix: str = "_") -> Column:
    """x lies in the open interval of rank j."""
    lo, hi = F.col(f"{prefix}lo{j}"), F.col(f"{prefix}hi{j}")
    return (lo.isNull() | (x > lo)) & (hi.isNull() | (x < hi))


def _ranks(n: Column, p: float, discrete: bool) -> tuple[Column, Column, Column]:
    """(rank below, rank above, position) of probability p among n values, ranks from 0."""
    if discrete:
        rank = F.greatest(F.ceil(n * p) - 1, F.lit(0)).cast("long")
        return rank, rank, rank.cast("double")
    at = (n - 1) * F.lit(float(p))
    return F.floor(at).cast("long"), F.ceil(at).cast("long"), at


def _narrowed(values: DataFrame, state: DataFrame, keys: list[str], ranks: int, leaf: int) -> DataFrame:
    """One round for every rank whose interval has more than ``leaf`` values."""
    x, fixed = F.col("_x"), state.columns
    wide = [F.col(f"_v{j}").isNull() & (F.col(f"_c{j}") > leaf) for j in range(ranks)]
    grid = [i / (GRID + 1) for i in range(1, GRID + 1)]
    sketch = [F.percentile_approx(F.when(wide[j] & _inside(x, j), x), grid, ACCURACY).alias(f"_grid{j}") for j in range(ranks)]
    got = _with_state(values, state, keys).groupBy(*keys).agg(*sketch)
    cut = state.join(got, [state[k].eqNullSafe(got[k]) for k in keys], "left").select(*[state[c] for c in fixed], *[got[f"_grid{j}"] for j in range(ranks)]) if keys else attach_one_row(state, got)

    def point(j: int, step: int) -> Column:  # the grid point ``step`` away from where the rank should be
        at = F.floor((F.col(f"_t{j}") - F.col(f"_b{j}")) / F.col(f"_c{j}") * (GRID + 1)).cast("int") + step
        return F.when((at >= 1) & (at <= GRID), F.get(F.col(f"_grid{j}"), at - 1))
    cut = write_and_read(cut.select(*fixed, *[point(j, s).alias(f"_{n}{j}") for j in range(ranks) for n, s in (("a", -1), ("z", 2))]), "quantile_cuts")
    counts = [F.count_if(test).alias(f"_{n}{j}{kind}") for j in range(ranks) for n in "az" for kind, test in (("l", x < F.col(f"_{n}{j}")), ("e", x <= F.col(f"_{n}{j}")))]
    n = _with_state(values, cut, keys).groupBy(*keys).agg(*counts)
    both = cut.join(n, [cut[k].eqNullSafe(n[k]) for k in keys]).select(*[cut[c] for c in cut.columns], *[n[c] for c in n.columns if c not in keys]) if keys else attach_one_row(cut, n)

    out = list(keys) + ["_n"]
    for j in range(ranks):
        t, v, lo, hi, b, c = (F.col(f"_{m}{j}") for m in ("t", "v", "lo", "hi", "b", "c"))
        a, z, al, ae, zl, ze = F.col(f"_a{j}"), F.col(f"_z{j}"), F.col(f"_a{j}l"), F.col(f"_a{j}e"), F.col(f"_z{j}l"), F.col(f"_z{j}e")
        at = lambda p, less, upto: p.isNotNull() & (less <= t) & (t < upto)
        above = a.isNotNull() & (t >= ae)
        above_z = z.isNotNull() & (t >= ze)
        below, below_a = z.isNotNull() & (t < zl), a.isNotNull() & (t < al)
        new_b = F.when(above_z, ze).when(above, ae).otherwise(b)
        new_top = F.when(below_a, al).when(below, zl).otherwise(b + c)
        out += [t, F.when(v.isNotNull(), v).when(at(a, al, ae), a).when(at(z, zl, ze), z).alias(f"_v{j}"),
                F.when(above_z, z).when(above, a).otherwise(lo).alias(f"_lo{j}"), F.when(below_a, a).when(below, z).otherwise(hi).alias(f"_hi{j}"),
                new_b.alias(f"_b{j}"), (new_top - new_b).alias(f"_c{j}")]
    return both.select(*out)


def exact_quantiles(values: DataFrame, keys: list[str], column: str, probs: list[float], discrete: bool = False, leaf: int = LEAF) -> DataFrame:
    """``keys, n, q``: exact quantiles of the non-NULL values of ``column`` in each group.

    Interpolated between neighbouring ranks (as ``percentile`` and a pandas
    quantile), or the value at rank ceil(p * n) with ``discrete`` (as
    ``percentile_disc``).  Groups without a value are absent; without keys
    there is always one row.  ``values`` is scanned twice at least and must be
    cheap to read.  Values compare as Spark doubles (NaN is the largest).
    """
    values = values.select(*keys, F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    ranks = 2 * len(probs)
    n, state = F.col("_n"), []
    for i, p in enumerate(probs):
        for j, t in zip((2 * i, 2 * i + 1), _ranks(n, p, discrete)):
            state += [t.alias(f"_t{j}"), *[F.lit(None).cast("double").alias(f"_{m}{j}") for m in ("v", "lo", "hi")], F.lit(0).cast("long").alias(f"_b{j}"), n.alias(f"_c{j}")]
    at = write_and_read(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_n", *state), "quantile_state")
    open_ = reduce(lambda a, b: a | b, [F.col(f"_v{j}").isNull() & (F.col(f"_c{j}") > leaf) for j in range(ranks)])
    while not at.where(open_).isEmpty():
        at = write_and_read(_narrowed(values, at, keys, ranks, leaf), "quantile_state")
    x = F.col("_x")
    left = reduce(lambda a, b: a | b, [F.col(f"_v{j}").isNull() & _inside(x, j) for j in range(ranks)])
    rest = _with_state(values, at, keys).where(left).groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_rest"))  # ``leaf`` values a rank at most
    both = at.join(rest, [at[k].eqNullSafe(rest[k]) for k in keys], "left").select(*[at[c] for c in at.columns], rest["_rest"]) if keys else attach_one_row(at, rest)

    def value(j: int) -> Column:
        return F.coalesce(F.col(f"_v{j}"), F.get(F.filter("_rest", lambda v: _inside(v, j)), (F.col(f"_t{j}") - F.col(f"_b{j}")).cast("int")))
    solved = both.select(*keys, "_n", *[value(j).alias(f"_v{j}") for j in range(ranks)])

    def quantile(i: int, p: float) -> Column:
        lo, hi, (below, above, at) = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}"), _ranks(n, p, discrete)
        return F.when((below == above) | (lo == hi), lo).otherwise((above - at) * lo + (at - below) * hi)
    return solved.select(*keys, F.col("_n").alias("n"), F.array(*[quantile(i, p) for i, p in enumerate(probs)]).alias("q"))


def melted(df: DataFrame, columns: list[str], name: str = "variable", value: str = "x") -> DataFrame:
    """``name, value``: the numeric columns as rows, NULLs kept."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])).alias("_m")).select("_m.*")


def group_medians(df: DataFrame, keys: list[str], column: str, exact: bool = True) -> DataFrame:
    """``keys, _med``: exact and interpolated (pandas ``median``), or with ``exact=False``
    a value near the middle from one scan (``percentile_approx``)."""
    if not exact:
        return df.groupBy(*keys).agg(F.percentile_approx(column, 0.5, 10_000).alias("_med"))
    return exact_quantiles(df, keys, column, [0.5]).select(*keys, F.col("q")[0].alias("_med"))


def column_medians(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """One row with the median of each column, NULL for a column without values."""
    m = group_medians(melted(df, columns), ["variable"], "x", exact)
    return m.agg(*[F.max(F.when(F.col("variable") == c, F.col("_med"))).alias(c) for c in columns])
