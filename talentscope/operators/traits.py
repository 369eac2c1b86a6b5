"""Trait vectors: one row per person holding all their traits.

The sources of a person's traits meet in one grouped aggregate by person,
which collects and sorts rows: yearly rows of other years than the newest
rated one go before it by a semi join with one row a person (hot people
apart), so that no older year is carried, sorted or spilled.  Jobs
come to the vectors, not the other way round: a job's baselines are two
arrays (trait keys, scores), all jobs of a set are one small broadcast row,
and array functions look every trait up.  TV, group and final rates of
(person, job) are therefore one scan of the vectors: no join on trait names,
no fan-out before a shuffle, no shuffle.

A person with more than ``PART_ROWS`` rows is kept in several parts: their
equal rows are first counted map-side (``n`` of a trait), the distinct ones
are dealt over parts by hash, and only such people's group rates are summed
over their parts.  Jobs whose baselines exceed ``SET_BYTES`` together are
dealt over several sets, each one scan.  Trait names are a dimension (pillars,
scales); their keys are 64-bit hashes of (group, trait).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentscope.functions.numeric import rnd
from talentscope.functions.scoring import TGV_NAMES, TGV_WEIGHTS, tv_match_rate, weighted_sum
from talentscope.session import attach_one_row, broadcast_if_small, measured_bytes, write_and_read
from talentscope.sources.tables import TalentTables

#: Rows of a person that one vector may hold, and bytes of baselines in one broadcast row.
PART_ROWS, SET_BYTES = 50_000, 16 * 2**20

# Trait names of the psych columns.
COGNITIVE_TRAITS = [("iq", "IQ"), ("gtq", "GTQ"), ("tiki", "TIKI")]
NAMES = ["fullname", "directorate", "role", "grade"]


def people_with_dims(t: TalentTables) -> DataFrame:
    """``employee_id, fullname, directorate, role, grade`` (dimension names
    by left join: the dimension tables are tiny)."""
    e = t.employees
    return (
        e.select("employee_id", "fullname", "directorate_id", "position_id", "grade_id")
        .join(t.dim_directorates.select("directorate_id", F.col("name").alias("directorate")), "directorate_id", "left")
        .join(t.dim_positions.select("position_id", F.col("name").alias("role")), "position_id", "left")
        .join(t.dim_grades.select("grade_id", F.col("name").alias("grade")), "grade_id", "left")
        .select("employee_id", *NAMES)
    )


def trait_key(tgv: Column | str, tv: Column | str) -> Column:
    """Key of a trait; NULL for a trait without a name, which matches nothing."""
    return F.when(F.col(tv).isNotNull() if isinstance(tv, str) else tv.isNotNull(), F.xxhash64(tgv, tv))


def trait_rows(t: TalentTables) -> DataFrame:
    """``employee_id, tgv_name, tv_name, user_score, direction, year, dated``:
    the trait rows of all sources, yearly ones (``dated``) of every year."""
    def part(df: DataFrame, tgv: str, tv: Column, score: Column, direction: str, year: Column | None = None) -> DataFrame:
        return df.select("employee_id", F.lit(tgv).alias("tgv_name"), tv.alias("tv_name"), score.cast("double").alias("user_score"), F.lit(direction).alias("direction"),
                         (F.lit(None) if year is None else year).cast("int").alias("year"), F.lit(year is not None).alias("dated"))
    known = F.col("employee_id").isNotNull()
    cog = t.profiles_psych.select("employee_id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).alias("v")) for c, n in COGNITIVE_TRAITS])).alias("_t"))
    strengths = t.strengths.groupBy("employee_id").agg(F.avg("rank").alias("avg_rank"))
    parts = [
        part(t.competencies_yearly.where(known).join(t.dim_competency_pillars, "pillar_code"), "Competencies", F.col("pillar_label"), F.col("score"), "higher", F.col("year")),
        part(cog, "Cognitive", F.col("_t.n"), F.col("_t.v"), "higher"),
        part(t.papi_scores, "PersonalityPAPI", F.col("scale_code"), F.col("score"), "higher"),
        part(t.performance_yearly.where(known), "Context", F.lit("PerformanceRating"), F.col("rating"), "higher", F.col("year")),
        part(strengths, "BehaviorStrengths", F.lit("StrengthsRankAvg"), F.col("avg_rank"), "lower"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _trait(n: Column, row: Column | None = None) -> Column:
    tgv, tv, score, direction = (F.col(c) if row is None else row[c] for c in ("tgv_name", "tv_name", "user_score", "direction"))
    return F.struct(trait_key(tgv, tv).alias("key"), tgv.alias("tgv_name"), tv.alias("tv_name"), score.alias("user_score"), direction.alias("direction"), n.cast("long").alias("n"))


def trait_vectors(t: TalentTables, part_rows: int = PART_ROWS) -> DataFrame:
    """``employee_id, part, parts, people, traits``, not yet written.

    ``traits``: array<struct<key, tgv_name, tv_name, user_score, direction, n>>
    at the person's newest rated year; ``people``: the person's names and
    dimensions, one entry per row of the employee table.
    """
    rows, newest = trait_rows(t), F.max(F.when(F.col("tgv_name") == "Context", F.col("year")))
    people = people_with_dims(t).where("employee_id is not null").select("employee_id", F.struct(*NAMES).alias("person"))
    counted = write_and_read(rows.groupBy("employee_id").agg(F.count(F.lit(1)).alias("_n"), newest.alias("_newest")), "counted_people")
    hot = write_and_read(counted.where(F.col("_n") > part_rows)
                         .select(F.col("employee_id").alias("_hot"), F.ceil(F.col("_n") / part_rows).cast("int").alias("parts"), "_newest"), "hot_people")
    none = hot.isEmpty()

    def cold(df: DataFrame) -> DataFrame:
        return df if none else df.join(broadcast_if_small(hot.select("_hot")), F.col("employee_id").eqNullSafe(F.col("_hot")), "left_anti")
    # older years go before rows are collected; a cold person has few rows, and the hashed side one
    years = broadcast_if_small(counted.where("_newest is not null").select(F.col("employee_id").alias("_e"), "_newest").hint("shuffle_hash"))
    yearly = cold(rows.where("dated")).join(years, (F.col("employee_id") == F.col("_e")) & (F.col("year") == F.col("_newest")), "left_semi")
    one = yearly.unionByName(cold(rows.where("not dated")))
    one = one.select("employee_id", F.struct("tgv_name", "tv_name", "user_score", "direction").alias("row"), F.lit(None).cast(people.schema["person"].dataType).alias("person"))
    one = one.unionByName(cold(people).select("employee_id", F.lit(None).cast(one.schema["row"].dataType).alias("row"), "person"))
    one = one.groupBy("employee_id").agg(F.collect_list("row").alias("rows"), F.collect_list("person").alias("people"))
    one = one.select("employee_id", F.lit(0).alias("part"), F.lit(1).alias("parts"), "people", F.transform("rows", lambda r: _trait(F.lit(1), r)).alias("traits"))
    if none:
        return one
    some = rows.join(broadcast_if_small(hot), F.col("employee_id").eqNullSafe(F.col("_hot"))).where(~F.col("dated") | (F.col("year") == F.col("_newest")))
    names = ["tgv_name", "tv_name", "user_score", "direction"]
    some = some.groupBy("employee_id", "parts", *names).agg(F.count(F.lit(1)).alias("_n"))  # equal rows are one, combined map-side
    some = some.withColumn("part", F.pmod(F.xxhash64(*names), F.col("parts")).cast("int")).groupBy("employee_id", "part", "parts").agg(F.collect_list(_trait(F.col("_n"))).alias("traits"))
    theirs = (people.join(broadcast_if_small(hot.select("_hot")), F.col("employee_id") == F.col("_hot"), "left_semi")
              .groupBy(F.col("employee_id").alias("_hot")).agg(F.collect_list("person").alias("people")))
    some = some.join(broadcast_if_small(theirs), F.col("employee_id") == F.col("_hot"), "left").select(
        "employee_id", "part", "parts", F.coalesce("people", F.array().cast(one.schema["people"].dataType)).alias("people"), "traits")
    return one.unionByName(some)


def without_tiki(vectors: DataFrame) -> DataFrame:
    """The same vectors without the TIKI trait."""
    return vectors.withColumn("traits", F.filter("traits", lambda x: (x["tgv_name"] != "Cognitive") | (x["tv_name"] != "TIKI")))


def _copies(traits: Column | str) -> Column:
    """A trait that stands for n equal rows, n times."""
    return F.explode(F.flatten(F.transform(traits, lambda x: F.array_repeat(x, x["n"].cast("int")))))


def tv_rows(vectors: DataFrame) -> DataFrame:
    """``employee_id, tgv_name, tv_name, user_score, direction``: the vectors as rows."""
    return vectors.select("employee_id", _copies("traits").alias("x")).select("employee_id", "x.tgv_name", "x.tv_name", "x.user_score", "x.direction")


# ------------------------------------------------------------------ jobs beside a vector

def job_sets(baseline: DataFrame, max_bytes: int = SET_BYTES) -> list[DataFrame]:
    """One-row tables (written) with ``jobs``: array<struct<job_vacancy_id, keys, scores>>,
    each of about ``max_bytes`` at most.  The first also holds a job without an
    id, whose keys are the traits of all jobs: traits outside them have no job.
    ``baseline`` is measured here, so it should be written."""
    base = baseline.where("tv_name is not null").select("job_vacancy_id", F.struct(trait_key("tgv_name", "tv_name").alias("k"), F.col("baseline_score").alias("s")).alias("b"))
    sets = -(-measured_bytes(baseline.select("job_vacancy_id", "baseline_score")) // max_bytes)
    if sets > 1:  # a set holds a job at least
        sets = min(sets, baseline.select("job_vacancy_id").distinct().count())
    sets = max(sets, 1)
    per_job = base.groupBy("job_vacancy_id").agg(F.collect_list("b").alias("b"))
    job = F.struct("job_vacancy_id", F.transform("b", lambda x: x["k"]).alias("keys"), F.transform("b", lambda x: x["s"]).alias("scores"))
    rows = [per_job.where(F.pmod(F.xxhash64("job_vacancy_id"), F.lit(sets)) == i).agg(F.collect_list(job).alias("jobs")) for i in range(sets)]
    known = base.agg(F.collect_set("b.k").alias("known"))  # trait names are a dimension
    kind = rows[0].schema["jobs"].dataType.elementType
    absent = F.struct(F.lit(None).cast(kind["job_vacancy_id"].dataType).alias("job_vacancy_id"), F.col("known").alias("keys"), F.lit(None).cast("array<double>").alias("scores"))
    rows[0] = attach_one_row(rows[0], known).select(F.concat("jobs", F.array(absent)).alias("jobs"))
    return [write_and_read(r, "job_set") for r in rows]


def _matched(job: Column, traits: Column) -> Column:
    """The traits that the job has a baseline for (of the job without an id: that no job has), with their rates."""
    absent = job["scores"].isNull()
    found = F.filter(traits, lambda x: F.when(absent, x["key"].isNull() | ~F.array_contains(job["keys"], x["key"])).otherwise(F.array_contains(job["keys"], x["key"])))

    def rated(x: Column) -> Column:
        base = F.when(~absent, F.get(job["scores"], F.array_position(job["keys"], x["key"]).cast("int") - 1))
        return F.struct(x["tgv_name"].alias("tgv_name"), x["tv_name"].alias("tv_name"), base.alias("baseline_score"), x["user_score"].alias("user_score"),
                        x["direction"].alias("direction"), tv_match_rate(x["user_score"], base, x["direction"]).alias("tv_match_rate"), x["n"].alias("n"))
    return F.transform(found, rated)


def _group_sums(tvs: Column, names: list[str]) -> list[Column]:
    """Per group: sum of rates, number of rates, number of rows."""
    def of(g: str) -> list[Column]:
        mine = F.filter(tvs, lambda x: x["tgv_name"] == g)
        none = F.lit(0).cast("long")
        return [F.aggregate(mine, F.lit(0.0), lambda a, x: a + F.coalesce(x["tv_match_rate"] * x["n"], F.lit(0.0))).alias(f"_s_{g}"),
                F.aggregate(mine, none, lambda a, x: a + F.when(x["tv_match_rate"].isNotNull(), x["n"]).otherwise(none)).alias(f"_k_{g}"),
                F.aggregate(mine, none, lambda a, x: a + x["n"]).alias(f"_c_{g}")]
    return [c for g in names for c in of(g)]


def scored(vectors: DataFrame, sets: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """``employee_id, part, parts, people, job_vacancy_id, tvs`` and, for the groups
    in ``names``, their sums: one row per (vector, job) with a trait in common.

    One scan of the vectors a set.  The row is made inside ``explode`` so that
    ``tvs`` is computed once, whatever reads it.
    """
    def one(jobs: DataFrame) -> DataFrame:
        pairs = attach_one_row(vectors, jobs).select("employee_id", "part", "parts", "people", "traits", F.explode("jobs").alias("job"))
        row = F.transform(F.array(_matched(F.col("job"), F.col("traits"))), lambda tvs: F.struct(tvs.alias("tvs"), *_group_sums(tvs, names or [])))
        rows = pairs.select("employee_id", "part", "parts", "people", "job.job_vacancy_id", F.explode(F.filter(row, lambda r: F.size(r["tvs"]) > 0)).alias("r"))
        return rows.select("employee_id", "part", "parts", "people", "job_vacancy_id", "r.*")
    return reduce(DataFrame.unionByName, [one(jobs) for jobs in sets])


def match_tv(vectors: DataFrame, sets: list[DataFrame]) -> DataFrame:
    """``employee_id, job_vacancy_id, tgv_name, tv_name, baseline_score,
    user_score, direction, tv_match_rate`` for every job having the trait;
    a trait no job has stays once, with NULL job and rate."""
    return scored(vectors, sets).select("employee_id", "job_vacancy_id", _copies("tvs").alias("x")).select("employee_id", "job_vacancy_id", "x.*").drop("n")


def _rates(sums: DataFrame, names: list[str], weights: dict[str, float]) -> list[Column]:
    """Mean rate (``_g_``) and rows (``_c_``) of each group, and the rounded final rate (``_final``)."""
    rate = {g: F.when(F.col(f"_k_{g}") > 0, F.col(f"_s_{g}") / F.col(f"_k_{g}")) for g in names}
    final = rnd(weighted_sum({g: rate[g] for g in weights}, weights, missing_as_zero=True), 2)
    return [*[rate[g].alias(f"_g_{g}") for g in names], *[F.col(f"_c_{g}").alias(f"_c_{g}") for g in names], final.alias("_final")]


def _with_rates(vectors: DataFrame, sets: list[DataFrame], weights: dict[str, float]) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``scored`` rows of people in one part with their rates; for people in
    several parts the rows without rates, and the rates of (person, job)."""
    names = list(dict.fromkeys(TGV_NAMES + list(weights)))
    rows = scored(vectors, sets, names)
    one = rows.select("employee_id", "people", "job_vacancy_id", "tvs", *_rates(rows, names, weights))
    if vectors.where("parts > 1").isEmpty():
        return one, None, None
    many = rows.where("parts > 1")
    total = many.groupBy("employee_id", "job_vacancy_id").agg(*[F.sum(c).alias(c) for c in rows.columns if c.startswith(("_s_", "_k_", "_c_"))])
    total = write_and_read(total.select("employee_id", "job_vacancy_id", *_rates(total, names, weights)), "rates_over_parts")
    return rows.where("parts = 1").select("employee_id", "people", "job_vacancy_id", "tvs", *_rates(rows, names, weights)), many.select("employee_id", "people", "job_vacancy_id", "tvs"), total


def match_groups(vectors: DataFrame, sets: list[DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """One row per (person, job) with a TV row: each group's mean TV rate
    (``_g_<group>``) and rows (``_c_<group>``), the rounded final rate
    (``_final``) and the person's names.  One scan, no shuffle (people in parts: their sums)."""
    one, many, total = _with_rates(vectors, sets, weights or TGV_WEIGHTS)
    one = one.drop("tvs")
    if many is not None:
        people = vectors.where("parts > 1").groupBy(F.col("employee_id").alias("_e")).agg(F.first("people").alias("people"))
        one = one.unionByName(total.join(people, F.col("employee_id").eqNullSafe(F.col("_e"))).drop("_e"))
    kept = [c for c in one.columns if c != "people"]
    return one.select(*kept, F.explode("people").alias("_p")).select(*kept, *[F.col(f"_p.{n}").alias(n) for n in NAMES])


def match_detail(vectors: DataFrame, sets: list[DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Unrounded detail rows with names (see ``match.matching_detail``): one scan, no shuffle."""
    rows, many, total = _with_rates(vectors, sets, weights or TGV_WEIGHTS)
    if many is not None:
        theirs = broadcast_if_small(total.withColumnsRenamed({"employee_id": "_e", "job_vacancy_id": "_j"}))
        many = many.join(theirs, F.col("employee_id").eqNullSafe(F.col("_e")) & F.col("job_vacancy_id").eqNullSafe(F.col("_j")))
        rows = rows.unionByName(many.drop("_e", "_j"))
    names = [c[3:] for c in rows.columns if c.startswith("_g_")]
    rates = ["_final", *[f"_g_{g}" for g in names]]
    rows = rows.select("employee_id", "job_vacancy_id", "tvs", *rates, F.explode("people").alias("_p"))
    rows = rows.select("employee_id", "job_vacancy_id", *rates, "_p", _copies("tvs").alias("x"))
    group = reduce(lambda e, g: e.when(F.col("x.tgv_name") == g, F.col(f"_g_{g}")), names[1:], F.when(F.col("x.tgv_name") == names[0], F.col(f"_g_{names[0]}")))
    has_job = F.col("job_vacancy_id").isNotNull()
    return rows.select("job_vacancy_id", "employee_id", *[F.col(f"_p.{n}").alias(n) for n in NAMES], "x.tgv_name", "x.tv_name", "x.baseline_score", "x.user_score", "x.tv_match_rate",
                       F.when(has_job, group).alias("tgv_match_rate"), F.when(has_job, F.col("_final")).alias("final_match_rate"))
