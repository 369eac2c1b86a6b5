"""What do high performers have in common?  Profile counts and summaries.

Two families share each question:

* the SQL one counts every rating-5 performance row (``COUNT(*)`` after
  inner joins; a NULL label is its own group);
* the notebook one (``distinct=True``) counts distinct (person, year)
  high performers, looks attributes up with left joins and drops rows
  whose label is missing, as a pandas ``groupby`` does.

Counts are pre-aggregated per person before joining to the person's
attributes, so the join sees one row per person and a person with an
outsized number of rows never becomes a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentscope.functions.numeric import rnd, rnd_even, strip_ws
from talentscope.functions.text import blank_to_unknown
from talentscope.operators.common import (
    dim_lookup,
    high_performer_rows,
    high_performers,
)
from talentscope.operators.quantiles import exact_quantiles, melted
from talentscope.session import broadcast_if_small, write_and_read
from talentscope.sources.tables import TalentTables

DIM_LABELS = {"grade": "grade_name", "division": "division_name", "education": "education_level"}


def _hp_counts_per_person(t: TalentTables, distinct: bool) -> DataFrame:
    hp = high_performers(t.performance_yearly) if distinct else high_performer_rows(t.performance_yearly)
    return hp.groupBy("employee_id").agg(F.count(F.lit(1)).alias("n"))


def hp_by_year(t: TalentTables, distinct: bool = False) -> DataFrame:
    """``year, total_high_performers``."""
    hp = high_performers(t.performance_yearly) if distinct else high_performer_rows(t.performance_yearly)
    return hp.groupBy("year").agg(F.count(F.lit(1)).alias("total_high_performers"))


def hp_by_dim(t: TalentTables, dim: str, distinct: bool = False) -> DataFrame:
    """``<label>, total_high_performers`` for dim in grade / division / education."""
    table, key = dim_lookup(t, dim)
    label = DIM_LABELS[dim]
    per_person = _hp_counts_per_person(t, distinct)
    out = (
        per_person.join(t.employees.select("employee_id", key), "employee_id")
        .join(table.select(key, F.col("name").alias(label)), key)
        .groupBy(label)
        .agg(F.sum("n").alias("total_high_performers"))
    )
    return out.filter(F.col(label).isNotNull()) if distinct else out


def hp_by_profile(t: TalentTables, column: str, distinct: bool = False) -> DataFrame:
    """High performers by a psych text column (``disc_word`` or ``mbti``).

    SQL form: DISC word as is (label ``disc_profile``), MBTI blanks as
    'Unknown'.  Notebook form: label keeps the column name (``disc_word``
    / ``mbti_clean``); profiles without ``disc_word`` are counted by
    ``disc``; missing DISC words are dropped, MBTI is stripped
    and blanks become 'Unknown'.
    """
    per_person = _hp_counts_per_person(t, distinct)
    psych = t.profiles_psych
    if column == "disc_word":
        name = "disc_word" if distinct else "disc_profile"
        lab = F.col("disc_word" if "disc_word" in psych.columns else "disc").alias(name)
    elif column == "mbti":
        name = "mbti_clean" if distinct else "mbti"
        expr = F.coalesce(F.nullif(strip_ws("mbti"), F.lit("")), F.lit("Unknown")) if distinct else blank_to_unknown("mbti")
        lab = expr.alias(name)
    else:
        raise ValueError(column)
    out = (
        per_person.join(psych.select("employee_id", lab), "employee_id")
        .groupBy(name)
        .agg(F.sum("n").alias("total_high_performers"))
    )
    return out.filter(F.col(name).isNotNull()) if distinct else out


def score_summary(df: DataFrame, cols: list[str], half_even: bool = False) -> DataFrame:
    """One row: ``avg_<c>`` rounded to 2, then ``min_<c>``, ``max_<c>``."""
    r = rnd_even if half_even else rnd
    aggs = [r(F.avg(c), 2).alias(f"avg_{c}") for c in cols]
    for c in cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*aggs)


def iq_gtq_summary(t: TalentTables) -> DataFrame:
    return score_summary(t.profiles_psych, ["iq", "gtq"])


def tiki_summary(t: TalentTables) -> DataFrame:
    return score_summary(t.profiles_psych, ["tiki"])


def hp_psych_values(t: TalentTables, cols: list[str]) -> DataFrame:
    """Distinct high performers joined to their psych values (one row per
    (person, year) and psych row; people without a psych row drop out,
    which is what skipping NaN in a mean does)."""
    hp = high_performers(t.performance_yearly).select("employee_id")
    return hp.join(t.profiles_psych.select("employee_id", *cols), "employee_id")


def hp_score_summary(t: TalentTables, cols: list[str]) -> DataFrame:
    return score_summary(hp_psych_values(t, cols), cols, half_even=True)


def pillar_sums_at_latest(t: TalentTables) -> DataFrame:
    """One row per (person, pillar) of the person's newest rated year, without
    a join of raw rows: ``employee_id, pillar_code``, the ``score_sum``,
    ``scores`` and ``score_rows`` of the competency rows and the ``rating_sum``,
    ``ratings`` and ``rating_rows`` of the performance rows of that year.

    Both tables are summed per (person, year) map-side, so a person with a
    third of all rows meets the second exchange as a row a year and pillar;
    there an aggregate by person picks the newest rated year.
    """
    comp = t.competencies_yearly.groupBy("employee_id", "year", "pillar_code").agg(
        F.sum("score").alias("score_sum"), F.count("score").alias("scores"), F.count(F.lit(1)).alias("score_rows"))
    perf = t.performance_yearly.groupBy("employee_id", "year").agg(
        F.sum("rating").alias("rating_sum"), F.count("rating").alias("ratings"), F.count(F.lit(1)).alias("rating_rows"))
    rated = F.struct("year", "rating_sum", "ratings", "rating_rows")  # one a year, so the greatest is the newest year's
    pillar = F.struct("year", "pillar_code", "score_sum", "scores", "score_rows")
    both = perf.select("employee_id", rated.alias("p")).unionByName(comp.select("employee_id", pillar.alias("c")), allowMissingColumns=True)
    person = both.where("employee_id is not null").groupBy("employee_id").agg(F.max("p").alias("p"), F.collect_list("c").alias("cs"))
    newest = person.select("employee_id", "p", F.explode(F.filter("cs", lambda c: c["year"] == F.col("p.year"))).alias("c"))
    return newest.select("employee_id", "c.pillar_code", "c.score_sum", "c.scores", "c.score_rows", "p.rating_sum", "p.ratings", "p.rating_rows")


def pillar_avg_latest(t: TalentTables) -> DataFrame:
    """``pillar_code, pillar_label, avg_score``: latest-year competency mean per pillar."""
    return (
        pillar_sums_at_latest(t)
        .groupBy("pillar_code")
        .agg(F.sum("score_sum").alias("s"), F.sum("scores").alias("c"))
        .join(t.dim_competency_pillars, "pillar_code")
        .groupBy("pillar_code", "pillar_label")
        .agg(rnd(F.sum("s") / F.nullif(F.sum("c"), F.lit(0)), 2).alias("avg_score"))
    )


def pillar_vs_rating(t: TalentTables) -> DataFrame:
    """``pillar_label, avg_competency_score, avg_performance_rating`` at the
    latest year: means over the pairs of a person's competency and performance
    rows, from their sums and counts."""
    pairs = pillar_sums_at_latest(t).groupBy("pillar_code").agg(
        F.sum(F.col("score_sum") * F.col("rating_rows")).alias("ss"), F.sum(F.col("scores") * F.col("rating_rows")).alias("sn"),
        F.sum(F.col("rating_sum") * F.col("score_rows")).alias("rs"), F.sum(F.col("ratings") * F.col("score_rows")).alias("rn"))
    mean = lambda total, n: rnd(F.sum(total) / F.nullif(F.sum(n), F.lit(0)), 2)
    return (
        pairs.join(t.dim_competency_pillars, "pillar_code")
        .groupBy("pillar_label")
        .agg(mean("ss", "sn").alias("avg_competency_score"), mean("rs", "rn").alias("avg_performance_rating"))
    )


def hp_competencies(t: TalentTables) -> DataFrame:
    """Competency rows of (person, year) pairs that were rated 5."""
    return t.competencies_yearly.join(high_performers(t.performance_yearly), ["employee_id", "year"], "left_semi")


def hp_pillar_avg(t: TalentTables) -> DataFrame:
    return (
        hp_competencies(t)
        .join(t.dim_competency_pillars, "pillar_code")
        .filter(F.col("pillar_label").isNotNull())
        .groupBy("pillar_code", "pillar_label")
        .agg(rnd_even(F.avg("score"), 2).alias("avg_score"))
    )


def hp_pillar_vs_rating(t: TalentTables) -> DataFrame:
    perf = t.performance_yearly.select("employee_id", "year", "rating")
    return (
        hp_competencies(t)
        .join(perf, ["employee_id", "year"], "left")
        .join(t.dim_competency_pillars, "pillar_code")
        .filter(F.col("pillar_label").isNotNull())
        .groupBy("pillar_label")
        .agg(
            rnd_even(F.avg("score"), 2).alias("avg_competency_score"),
            rnd_even(F.avg("rating"), 2).alias("avg_performance_rating"),
        )
    )


# How many labels each top-N chart keeps.
TOP_N = {"grade": 15, "division": 20, "disc": 12, "mbti": 5}


def hp_counts(t: TalentTables) -> DataFrame:
    """``dimension, label, total_high_performers`` for year, grade, division,
    education, disc and mbti at once: the notebook counts (distinct (person,
    year) high performers, rows without a label dropped).

    One set of high performers, one row per person, meets the person's
    attributes once; a row (dimension, key) per attribute is counted map-side.
    Grade, division and education keys are named by their dimension tables
    after the count.
    """
    hp = high_performer_rows(t.performance_yearly).groupBy("employee_id").agg(
        F.collect_set("year").alias("years"), F.max(F.col("year").isNull().cast("int")).alias("undated"))
    hp = hp.select("employee_id", "years", (F.size("years") + F.col("undated")).cast("long").alias("n"))
    pair = lambda dim, key: F.struct(F.lit(dim).alias("dimension"), F.col(key).cast("string").alias("key") if isinstance(key, str) else key.alias("key"))
    word = "disc_word" if "disc_word" in t.profiles_psych.columns else "disc"
    mbti = F.coalesce(F.nullif(strip_ws("mbti"), F.lit("")), F.lit("Unknown"))
    facts = t.employees.select("employee_id", F.array(*[pair(d, dim_lookup(t, d)[1]) for d in DIM_LABELS]).alias("of")).unionByName(
        t.profiles_psych.select("employee_id", F.array(pair("disc", word), pair("mbti", mbti)).alias("of")))
    by_key = hp.join(facts, "employee_id").select(F.explode("of").alias("x"), "n").select("x.*", "n")
    by_year = hp.select(F.explode("years").alias("y")).select(F.lit("year").alias("dimension"), F.col("y").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))
    counts = by_key.unionByName(by_year).where("key is not null").groupBy("dimension", "key").agg(F.sum("n").alias("n"))
    names = None
    for d in DIM_LABELS:
        table, key = dim_lookup(t, d)
        part = table.select(F.lit(d).alias("dimension"), F.col(key).cast("string").alias("key"), F.col("name").alias("label"))
        names = part if names is None else names.unionByName(part)
    named = counts.join(broadcast_if_small(names), ["dimension", "key"], "left").withColumn(
        "label", F.when(F.col("dimension").isin(*DIM_LABELS), F.col("label")).otherwise(F.col("key")))
    return named.where("label is not null").groupBy("dimension", "label").agg(F.sum("n").alias("total_high_performers"))


def hp_top_n(t: TalentTables, top_n: dict[str, int] | None = None) -> DataFrame:
    """``dimension, label, total_high_performers, rank_in_dimension``: the
    most frequent labels per dimension, ties by label."""
    top_n = top_n or TOP_N
    kept = F.create_map(*[F.lit(x) for pair in top_n.items() for x in pair])
    w = Window.partitionBy("dimension").orderBy(F.col("total_high_performers").desc(), F.col("label"))
    return (
        hp_counts(t).where(F.col("dimension").isin(*top_n))
        .withColumn("rank_in_dimension", F.row_number().over(w))
        .filter(F.col("rank_in_dimension") <= max(top_n.values()))
        .filter(F.col("rank_in_dimension") <= kept[F.col("dimension")])
    )


def histogram(values: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """``variable, bin, bin_lo, bin_hi, n``: equal-width bins over [min, max],
    the last bin closed, empty bins included (how a 20-bar chart counts).

    The input is read once: counts per value (combined map-side, written)
    give both the bounds and the bins.  The bin grid (variables x bins rows)
    is generated from the bounds and left-joined, so empty bins show as 0.
    """
    long = melted(values, cols).where(F.col("x").isNotNull()).groupBy("variable", "x").agg(F.count(F.lit(1)).alias("c"))
    long = write_and_read(long, "value_counts")
    bounds = long.groupBy("variable").agg(F.min("x").alias("lo0"), F.max("x").alias("hi0"))
    bounds = bounds.select(
        "variable",
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
    )
    b = F.broadcast(bounds)  # a row a variable
    idx = F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    counts = long.join(b, "variable").groupBy("variable", idx.cast("int").alias("bin")).agg(F.sum("c").alias("n"))
    grid = b.select("variable", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(F.broadcast(counts), ["variable", "bin"], "left").select(  # variables x bins rows
        "variable",
        "bin",
        rnd(F.col("lo") + F.col("bin") * width, 4).alias("bin_lo"),
        rnd(F.col("lo") + (F.col("bin") + 1) * width, 4).alias("bin_hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
    )


def box_stats(values: DataFrame, cols: list[str]) -> DataFrame:
    """``variable, n, q1, median, q3, iqr, whisker_lo, whisker_hi, n_outliers``
    with exact linear-interpolated quartiles and 1.5 x IQR whiskers.  ``values``
    is written once and scanned by each narrowing round."""
    long = write_and_read(melted(values, cols).where(F.col("x").isNotNull()), "box_values")
    q = exact_quantiles(long, ["variable"], "x", [0.25, 0.5, 0.75]).select(
        "variable", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_fence = F.col("q1") - 1.5 * F.col("iqr")
    hi_fence = F.col("q3") + 1.5 * F.col("iqr")
    inside = (F.col("x") >= lo_fence) & (F.col("x") <= hi_fence)
    return (
        long.join(broadcast_if_small(write_and_read(q, "quartiles")), "variable")
        .groupBy("variable", "n", "q1", "median", "q3", "iqr")
        .agg(
            F.min(F.when(inside, F.col("x"))).alias("whisker_lo"),
            F.max(F.when(inside, F.col("x"))).alias("whisker_hi"),
            F.count(F.when(~inside, F.lit(1))).alias("n_outliers"),
        )
        .select("variable", "n", rnd("q1", 4).alias("q1"), rnd("median", 4).alias("median"),
                rnd("q3", 4).alias("q3"), rnd("iqr", 4).alias("iqr"), "whisker_lo", "whisker_hi", "n_outliers")
    )
