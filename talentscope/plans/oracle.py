"""Independent SQL for every named query, runnable by DuckDB over the
driver's parquet views (region, nation, customer, orders, lineitem, ...).

Each statement first rebuilds the talent tables from the driver tables
with the same rules as ``talentscope.sources.mapping`` (as CTEs), then
answers the question in plain single-engine SQL, deliberately different
from the Spark plans: window functions for bounds, medians, group rates
and ranks (where Spark uses aggregates joined back and a value
histogram), ``UNPIVOT`` and ``UNNEST`` for the long forms,
``quantile_disc`` for cohort medians.  Agreement of the two shows the
Spark plans compute the same thing by other means.

Rounding uses the same decimal(28,10) step as ``functions.numeric``.
"""

from __future__ import annotations

import re

from talentscope.sources.mapping import (
    DEFAULT_WEIGHTS_JSON,
    DISC_PROFILES,
    EDUCATION,
    GRADES,
    MBTI_TYPES,
    PILLARS,
    POSITIONS,
    UNKNOWN_ID,
)


# Parsing rules, stated here on their own: what a number looks like, and
# what a CSV reader takes as missing.
NUMBER = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"
MISSING = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', "
           "'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")


def known(x: str) -> str:
    return f"(CASE WHEN {x} NOT IN ({MISSING}) THEN {x} END)"


def to_year(x: str) -> str:
    n = to_number(x)
    return f"(CASE WHEN {n} = TRUNC({n}) THEN TRY_CAST({n} AS INTEGER) END)"


def rnd(x: str, n: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,10)), {n}) AS DOUBLE)"


def rnd_even(x: str, n: int) -> str:
    return f"CAST(ROUND_EVEN(CAST({x} AS DECIMAL(28,10)), {n}) AS DOUBLE)"


def strip_ws(x: str) -> str:
    return rf"regexp_replace(CAST({x} AS VARCHAR), '^\s+|\s+$', '', 'g')"


def to_number(x: str) -> str:
    t = strip_ws(x)
    return f"(CASE WHEN regexp_full_match({t}, '{NUMBER}') THEN TRY_CAST({t} AS DOUBLE) END)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _values(rows, cols: str) -> str:
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else _q(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({cols})"


def disc_from_words(w: str) -> str:
    cases = " ".join(f"WHEN {_q(word.lower())} THEN {_q(letters)}" for letters, word in DISC_PROFILES[:4])
    return (
        f"NULLIF(array_to_string(list_filter(list_transform(string_split_regex(lower({w}), '[^a-z]+'), "
        f"lambda t: CASE t {cases} END), lambda x: x IS NOT NULL), ''), '')"
    )


def fill_disc(disc: str, word: str) -> str:
    d = f"COALESCE({known(disc)}, 'Unknown')"
    w = f"COALESCE({known(word)}, 'Unknown')"
    return f"COALESCE(CASE WHEN {d} <> 'Unknown' THEN {d} ELSE {disc_from_words(w)} END, 'Unknown')"


K = "CAST(regexp_extract(employee_id, '([0-9]+)$', 1) AS BIGINT)"

MAPPING = f"""
employees AS (
  SELECT 'EMP' || CAST(c.c_custkey AS VARCHAR) AS employee_id,
         c.c_name AS fullname,
         CAST(1 + c.c_custkey % 3 AS INTEGER) AS company_id,
         CAST(1 + c.c_nationkey % 4 AS INTEGER) AS area_id,
         c.c_mktsegment AS position_id,
         CAST(1 + c.c_custkey % 11 AS INTEGER) AS department_id,
         CAST(c.c_nationkey AS INTEGER) AS division_id,
         CAST(n.n_regionkey AS INTEGER) AS directorate_id,
         CAST(CASE WHEN c.c_custkey % 40 <> 0 THEN 1 + c.c_custkey % 7 END AS INTEGER) AS grade_id,
         CAST(1 + c.c_custkey % 5 AS INTEGER) AS education_id,
         CAST(1 + c.c_custkey % 9 AS INTEGER) AS major_id,
         CAST(c.c_custkey % 640 - 10 AS DOUBLE) AS years_of_service_months
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
),
performance_yearly AS (
  SELECT 'EMP' || CAST(o_custkey AS VARCHAR) AS employee_id, yr AS year,
         CAST(1 + LEAST(4, FLOOR(SUM(cents) / (COUNT(*) * 1.0e7))) AS DOUBLE) AS rating
  FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr,
               CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders) o
  GROUP BY o_custkey, yr
),
line_facts AS (
  SELECT o.o_custkey, CAST(year(o.o_orderdate) AS INTEGER) AS yr, l.l_linenumber,
         SUM(l.l_quantity) AS qty, COUNT(*) AS n, MIN(l.l_partkey) AS min_partkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey, CAST(year(o.o_orderdate) AS INTEGER), l.l_linenumber
),
competencies_yearly AS (
  SELECT 'EMP' || CAST(o_custkey AS VARCHAR) AS employee_id, yr AS year,
         'P' || CAST(l_linenumber AS VARCHAR) AS pillar_code,
         {rnd("qty / n / 10", 2)} AS score
  FROM line_facts
),
strengths AS (
  SELECT 'EMP' || CAST(o_custkey AS VARCHAR) AS employee_id, 'T' || CAST(l_linenumber AS VARCHAR) AS theme,
         CAST(1 + MIN(min_partkey) % 14 AS INTEGER) AS rank
  FROM line_facts GROUP BY o_custkey, l_linenumber
),
profiles_psych AS (
  SELECT 'EMP' || CAST(c_custkey AS VARCHAR) AS employee_id,
         CAST(20 + (29 * c_custkey) % 81 AS DOUBLE) AS pauli,
         CAST(1 + (11 * c_custkey) % 9 AS DOUBLE) AS faxtor,
         CAST(80 + (37 * c_custkey) % 61 AS DOUBLE) AS iq,
         CAST(20 + (53 * c_custkey) % 31 AS DOUBLE) AS gtq,
         CAST(1 + (17 * c_custkey) % 10 AS DOUBLE) AS tiki,
         CASE WHEN c_custkey % 6 <> 0 THEN ({_list([d for d, _ in DISC_PROFILES])})[CAST(1 + (7 * c_custkey) % 8 AS INTEGER)] END AS disc,
         CASE WHEN c_custkey % 45 = 0 THEN NULL WHEN c_custkey % 50 = 7 THEN 'Unclassified'
              ELSE ({_list([w for _, w in DISC_PROFILES])})[CAST(1 + (7 * c_custkey) % 8 AS INTEGER)] END AS disc_word,
         CASE WHEN c_custkey % 35 = 2 THEN NULL WHEN c_custkey % 30 = 1 THEN '  '
              ELSE ({_list(MBTI_TYPES)})[CAST(1 + (13 * c_custkey) % 16 AS INTEGER)] END AS mbti
  FROM customer
),
papi_scores AS (
  SELECT 'EMP' || CAST(o_custkey AS VARCHAR) AS employee_id, 'Papi_' || substr(o_orderpriority, 1, 1) AS scale_code,
         CAST(COUNT(*) AS DOUBLE) AS score
  FROM orders GROUP BY o_custkey, substr(o_orderpriority, 1, 1)
),
dim_grades AS ({_values(GRADES, "grade_id, name")}),
dim_education AS ({_values(EDUCATION, "education_id, name")}),
dim_positions AS ({_values(POSITIONS, "position_id, name")}),
dim_competency_pillars AS ({_values(PILLARS, "pillar_code, pillar_label")}),
dim_divisions AS (SELECT CAST(n_nationkey AS INTEGER) AS division_id, n_name AS name FROM nation),
dim_directorates AS (SELECT CAST(r_regionkey AS INTEGER) AS directorate_id, r_name AS name FROM region),
last_rated AS (SELECT employee_id, MAX(year) AS last_year FROM performance_yearly GROUP BY employee_id),
top_rated AS (
  SELECT y.employee_id FROM performance_yearly y JOIN last_rated r USING (employee_id)
  WHERE y.year = r.last_year AND y.rating = 5
),
bench_seed AS (
  SELECT e.directorate_id, t.employee_id,
         ROW_NUMBER() OVER (PARTITION BY e.directorate_id ORDER BY t.employee_id) AS rn
  FROM top_rated t JOIN employees e USING (employee_id)
),
bench_cohorts AS (
  SELECT directorate_id, list(employee_id ORDER BY employee_id) AS cohort
  FROM bench_seed WHERE rn <= 50 GROUP BY directorate_id
),
talent_benchmarks AS (
  SELECT CAST(r.r_regionkey + 1 AS INTEGER) AS job_vacancy_id, 'Analyst ' || r.r_name AS role_name,
         'Grade III' AS job_level, 'Benchmark of top performers in ' || r.r_name AS role_purpose,
         COALESCE(b.cohort, CAST([] AS VARCHAR[])) AS selected_talent_ids,
         {_q(DEFAULT_WEIGHTS_JSON)} AS weights_config,
         CAST('2025-01-' || lpad(CAST(r.r_regionkey + 1 AS VARCHAR), 2, '0') || ' 09:00:00' AS TIMESTAMP) AS created_at
  FROM region r LEFT JOIN bench_cohorts b ON b.directorate_id = r.r_regionkey
  UNION ALL SELECT 6, 'Empty Cohort', 'Grade II', 'Benchmark without people', CAST([] AS VARCHAR[]), '{{}}',
                   TIMESTAMP '2025-01-06 09:00:00'
  UNION ALL SELECT 7, 'Unknown Cohort', 'Grade II', 'Benchmark naming an unknown id', [{_q(UNKNOWN_ID)}], '{{}}',
                   TIMESTAMP '2025-01-07 09:00:00'
),
raw_employees0 AS (
  SELECT employee_id,
         CASE WHEN k % 50 = 4 THEN '  ' || fullname || ' ' ELSE fullname END AS fullname,
         CAST(company_id AS VARCHAR) AS company_id, CAST(area_id AS VARCHAR) AS area_id, position_id,
         CAST(department_id AS VARCHAR) AS department_id, CAST(division_id AS VARCHAR) AS division_id,
         CAST(directorate_id AS VARCHAR) AS directorate_id, CAST(grade_id AS VARCHAR) AS grade_id,
         CAST(education_id AS VARCHAR) AS education_id, CAST(major_id AS VARCHAR) AS major_id,
         CASE WHEN k % 97 = 11 THEN 'n/a' ELSE CAST(CAST(years_of_service_months AS BIGINT) AS VARCHAR) END
           AS years_of_service_months,
         k
  FROM (SELECT *, {K} AS k FROM employees)
),
raw_employees AS (
  SELECT * EXCLUDE (k) FROM raw_employees0
  UNION ALL SELECT * EXCLUDE (k) FROM raw_employees0 WHERE k % 200 = 3
),
raw_performance_yearly AS (
  SELECT employee_id, CASE WHEN k % 61 = 9 THEN CAST(year AS VARCHAR) || '.7' WHEN k % 67 = 10 THEN '99999999999'
                           WHEN k % 71 = 5 THEN CAST(year AS VARCHAR) || '.0' ELSE CAST(year AS VARCHAR) END AS year,
         CASE WHEN (k + year) % 23 = 0 THEN NULL
              WHEN (k + year) % 31 = 0 THEN 'n/a'
              WHEN k % 13 = 0 THEN ' ' || CAST(CAST(rating AS INTEGER) AS VARCHAR) || ' '
              ELSE CAST(CAST(rating AS INTEGER) AS VARCHAR) END AS rating
  FROM (SELECT *, {K} AS k FROM performance_yearly)
),
raw_competencies0 AS (
  SELECT employee_id, CASE WHEN k % 59 = 8 THEN CAST(year AS VARCHAR) || '.7' WHEN k % 73 = 6 THEN 'null'
                           ELSE CAST(year AS VARCHAR) END AS year, pillar_code,
         CASE WHEN pillar_code = 'P7' THEN NULL
              WHEN (k + line) % 17 = 0 THEN ''
              WHEN (k + year + line) % 29 = 0 THEN 'abc'
              WHEN k % 19 = 0 THEN ' ' || txt || ' '
              ELSE txt END AS score,
         k
  FROM (SELECT *, {K} AS k, CAST(substr(pillar_code, 2, 10) AS INTEGER) AS line,
               CAST(CAST(FLOOR(h / 100) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') AS txt
        FROM (SELECT *, CAST(ROUND(score * 100) AS BIGINT) AS h FROM competencies_yearly))
),
raw_competencies_yearly AS (
  SELECT * EXCLUDE (k) FROM raw_competencies0
  UNION ALL SELECT * EXCLUDE (k) FROM raw_competencies0 WHERE k % 50 = 0 AND pillar_code = 'P1'
),
raw_profiles_psych AS (
  SELECT employee_id,
         CASE WHEN k % 31 = 0 THEN '' ELSE CAST(CAST(pauli AS BIGINT) AS VARCHAR) END AS pauli,
         CAST(CAST(faxtor AS BIGINT) AS VARCHAR) AS faxtor,
         CASE WHEN k % 19 = 0 THEN '' ELSE CAST(CAST(iq AS BIGINT) AS VARCHAR) END AS iq,
         CASE WHEN k % 23 <> 0 THEN CAST(CAST(gtq AS BIGINT) AS VARCHAR) END AS gtq,
         CASE WHEN k % 29 = 0 THEN 'x' ELSE CAST(CAST(tiki AS BIGINT) AS VARCHAR) END AS tiki,
         CASE WHEN k % 41 = 5 THEN 'NA' ELSE disc END AS disc, CASE WHEN k % 43 = 7 THEN 'n/a' ELSE disc_word END AS disc_word,
         CASE WHEN k % 47 = 6 THEN 'NaN' ELSE mbti END AS mbti
  FROM (SELECT *, {K} AS k FROM profiles_psych)
),
raw_papi_scores AS (
  SELECT employee_id,
         CASE WHEN k % 11 = 0 THEN ' ' || scale_code || chr(9) ELSE scale_code END AS scale_code,
         CASE WHEN scale_code = 'Papi_5' THEN NULL
              WHEN k % 13 = 0 AND scale_code = 'Papi_3' THEN ''
              ELSE CAST(CAST(score AS BIGINT) AS VARCHAR) END AS score
  FROM (SELECT *, {K} AS k FROM papi_scores)
)"""


def with_mapping(*ctes: str) -> str:
    """``WITH <mapping>, <ctes>`` prefix."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {MAPPING}{extra}\n"


def trimmed(ctes: list[str], tail: str) -> str:
    """``WITH ... tail`` with the parts that the tail needs alone; parts read more than once are materialised."""
    parts = {c.strip().split(" ", 1)[0]: c.strip() for c in [*re.split(r",\n(?=\w+ AS \()", MAPPING), *ctes]}
    reads = {n: {m for m in parts if m != n and re.search(rf"\b(?:FROM|JOIN)\s+{m}\b", text)} for n, text in [*parts.items(), ("", tail)]}
    needed, todo = set(), [""]
    while todo:
        new = reads[todo.pop()] - needed
        needed |= new
        todo += new
    often = {n for n in needed if sum(n in reads[m] for m in [*needed, ""]) > 1}
    kept = [text.replace(f"{n} AS (", f"{n} AS MATERIALIZED (", 1) if n in often else text for n, text in parts.items() if n in needed]
    return "WITH " + ",\n".join(kept) + "\n" + tail


# ------------------------------------------------------------- shared pieces

CREATED = f"""created AS (
  SELECT * FROM talent_benchmarks
  UNION ALL
  SELECT (SELECT CAST(COALESCE(MAX(job_vacancy_id) + 1, 1) AS INTEGER) FROM talent_benchmarks),
         'Route Planner', 'Grade IV', 'Plan delivery routes that hold in bad weather.',
         COALESCE((SELECT list(employee_id ORDER BY employee_id)
                   FROM (SELECT employee_id FROM top_rated ORDER BY employee_id LIMIT 3)), CAST([] AS VARCHAR[])),
         '{{}}', TIMESTAMP '2025-02-01 10:00:00'
)"""


UPDATED = """updated AS (
  SELECT job_vacancy_id,
         CASE WHEN job_vacancy_id = 1
              THEN COALESCE((SELECT list(employee_id ORDER BY employee_id)
                             FROM (SELECT employee_id FROM top_rated ORDER BY employee_id LIMIT 50)),
                            CAST([] AS VARCHAR[]))
              ELSE selected_talent_ids END AS selected_talent_ids
  FROM talent_benchmarks
)"""


def cohort_summary(table: str) -> str:
    return (f"SELECT job_vacancy_id, CAST(COALESCE(len(selected_talent_ids), 0) AS BIGINT) AS cohort_size, "
            f"array_to_string(selected_talent_ids, ',') AS cohort FROM {table}")


CLEAN_EMPLOYEES = f"""clean_employees AS (
  SELECT employee_id, fullname,
         {to_number("company_id")} AS company_id, {to_number("area_id")} AS area_id, position_id,
         {to_number("department_id")} AS department_id, {to_number("division_id")} AS division_id,
         {to_number("directorate_id")} AS directorate_id, {to_number("grade_id")} AS grade_id,
         {to_number("education_id")} AS education_id, {to_number("major_id")} AS major_id,
         {to_number("years_of_service_months")} AS years_of_service_months
  FROM raw_employees
)"""

CLEAN_COMPETENCIES = f"""cc0 AS (
  SELECT employee_id, {to_year("year")} AS year, pillar_code, {to_number("score")} AS score
  FROM raw_competencies_yearly
),
clean_competencies AS (
  SELECT employee_id, year, pillar_code,
         {rnd_even("COALESCE(score, CASE WHEN pillar_code IS NOT NULL THEN median(score) OVER (PARTITION BY pillar_code) END, 3.0E0)", 1)} AS score
  FROM cc0
)"""

CLEAN_PERFORMANCE = f"""clean_performance AS (
  SELECT employee_id, year, COALESCE(rating, median(rating) OVER ()) AS rating
  FROM (SELECT employee_id, {to_year("year")} AS year, {to_number("rating")} AS rating FROM raw_performance_yearly)
)"""

# ---- match model: traits, cohort medians, rates; group and final rates by
# window over (person, job) instead of joins back to grouped rows.


def traits(include_tiki: bool = True) -> str:
    cog = ['iq AS "IQ"', 'gtq AS "GTQ"'] + (['tiki AS "TIKI"'] if include_tiki else [])
    names = ", ".join(c.split(" AS ")[1] for c in cog)
    return f"""traits AS (
  SELECT c.employee_id, 'Competencies' AS tgv_name, d.pillar_label AS tv_name,
         CAST(c.score AS DOUBLE) AS user_score, 'higher' AS direction
  FROM competencies_yearly c JOIN last_rated r USING (employee_id) JOIN dim_competency_pillars d USING (pillar_code)
  WHERE c.year = r.last_year
  UNION ALL
  SELECT employee_id, 'Cognitive', tv_name, CAST(user_score AS DOUBLE), 'higher'
  FROM (SELECT employee_id, {", ".join(cog)} FROM profiles_psych)
       UNPIVOT INCLUDE NULLS (user_score FOR tv_name IN ({names}))
  UNION ALL
  SELECT employee_id, 'PersonalityPAPI', scale_code, CAST(score AS DOUBLE), 'higher' FROM papi_scores
  UNION ALL
  SELECT y.employee_id, 'Context', 'PerformanceRating', CAST(y.rating AS DOUBLE), 'higher'
  FROM performance_yearly y JOIN last_rated r USING (employee_id) WHERE y.year = r.last_year
  UNION ALL
  SELECT employee_id, 'BehaviorStrengths', 'StrengthsRankAvg', AVG(rank), 'lower' FROM strengths GROUP BY employee_id
)"""


WEIGHTED_FINAL = " + ".join(
    f"{w}E0 * COALESCE(MAX(tgv_rate) FILTER (WHERE tgv_name = '{g}'), 0)"
    for g, w in [("Competencies", "0.4"), ("Cognitive", "0.3"), ("PersonalityPAPI", "0.15"),
                 ("Context", "0.1"), ("BehaviorStrengths", "0.05")]
)


def match_ctes(bench: str = "talent_benchmarks", include_tiki: bool = True) -> list[str]:
    return [
        traits(include_tiki),
        f"cohort AS (SELECT job_vacancy_id, UNNEST(selected_talent_ids) AS employee_id FROM {bench})",
        """medians AS (
  SELECT k.job_vacancy_id, t.tgv_name, t.tv_name, quantile_disc(t.user_score, 0.5) AS baseline_score
  FROM cohort k JOIN traits t USING (employee_id)
  GROUP BY k.job_vacancy_id, t.tgv_name, t.tv_name
)""",
        """rated AS (
  SELECT t.employee_id, m.job_vacancy_id, t.tgv_name, t.tv_name, m.baseline_score, t.user_score,
         CASE WHEN COALESCE(m.baseline_score, 0) = 0 THEN NULL
              WHEN t.direction = 'higher' THEN LEAST(100.0E0, 100.0E0 * (t.user_score / m.baseline_score))
              WHEN t.direction = 'lower' THEN GREATEST(0.0E0, LEAST(100.0E0,
                   100.0E0 * ((2 * m.baseline_score - t.user_score) / m.baseline_score)))
         END AS tv_rate
  FROM traits t LEFT JOIN medians m USING (tgv_name, tv_name)
)""",
        """grouped AS (
  SELECT *, AVG(tv_rate) OVER (PARTITION BY employee_id, job_vacancy_id, tgv_name) AS tgv_rate FROM rated
)""",
        f"""finals AS (
  SELECT employee_id, job_vacancy_id, {rnd(WEIGHTED_FINAL, 2)} AS final_rate
  FROM (SELECT DISTINCT employee_id, job_vacancy_id, tgv_name, tgv_rate FROM grouped)
  GROUP BY employee_id, job_vacancy_id
)""",
        f"""detail AS (
  SELECT f.job_vacancy_id, e.employee_id, e.fullname, dd.name AS directorate, dp.name AS role, dg.name AS grade,
         g.tgv_name, g.tv_name,
         {rnd("g.baseline_score", 2)} AS baseline_score, {rnd("g.user_score", 2)} AS user_score,
         {rnd("g.tv_rate", 2)} AS tv_match_rate,
         CASE WHEN g.job_vacancy_id IS NOT NULL THEN {rnd("g.tgv_rate", 2)} END AS tgv_match_rate,
         {rnd("f.final_rate", 2)} AS final_match_rate
  FROM grouped g
  JOIN employees e USING (employee_id)
  LEFT JOIN finals f ON f.employee_id = g.employee_id AND f.job_vacancy_id = g.job_vacancy_id
  LEFT JOIN dim_directorates dd USING (directorate_id)
  LEFT JOIN dim_positions dp USING (position_id)
  LEFT JOIN dim_grades dg USING (grade_id)
)""",
        """people_ranked AS (
  SELECT job_vacancy_id, employee_id, fullname, directorate, role, grade, MAX(final_match_rate) AS final_match_rate
  FROM detail
  WHERE job_vacancy_id IS NOT NULL
    AND fullname IS NOT NULL AND directorate IS NOT NULL AND role IS NOT NULL AND grade IS NOT NULL
  GROUP BY ALL
)""",
    ]


def top_per_job(n: int, src: str = "people_ranked") -> str:
    return f"""SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY job_vacancy_id
                               ORDER BY final_match_rate DESC NULLS LAST, employee_id) AS BIGINT) AS rank_in_job
FROM {src} QUALIFY rank_in_job <= {n}"""


MATCH = match_ctes()

# ---- readiness model: per-person parts with window bounds, one join to people.

PARTS = [
    f"""p_comp AS (
  SELECT c.employee_id, {rnd("AVG(c.score)", 2)} AS comp_avg, {rnd("AVG(c.score) / 5.0E0", 4)} AS part
  FROM competencies_yearly c JOIN last_rated r USING (employee_id)
  WHERE c.year = r.last_year GROUP BY c.employee_id
)""",
    f"""p_cog AS (
  SELECT employee_id,
         {rnd("((iq - MIN(iq) OVER ()) / NULLIF(MAX(iq) OVER () - MIN(iq) OVER (), 0) + (gtq - MIN(gtq) OVER ()) / NULLIF(MAX(gtq) OVER () - MIN(gtq) OVER (), 0)) / 2", 4)} AS part
  FROM profiles_psych
)""",
    f"""p_papi AS (
  SELECT employee_id, {rnd("AVG(z)", 4)} AS part
  FROM (SELECT employee_id,
               (score - MIN(score) OVER s) / NULLIF(MAX(score) OVER s - MIN(score) OVER s, 0) AS z
        FROM papi_scores WINDOW s AS (PARTITION BY scale_code))
  GROUP BY employee_id
)""",
    f"""p_ctx AS (
  SELECT y.employee_id, {rnd("y.rating / 5.0E0", 4)} AS part
  FROM performance_yearly y JOIN last_rated r USING (employee_id) WHERE y.year = r.last_year
)""",
    f"""p_str AS (
  SELECT employee_id, {rnd("1 - (a - MIN(a) OVER ()) / NULLIF(MAX(a) OVER () - MIN(a) OVER (), 0)", 4)} AS part
  FROM (SELECT employee_id, AVG(rank) AS a FROM strengths GROUP BY employee_id)
)""",
]

TOTAL = ("0.4E0 * pc.part + 0.3E0 * pg.part + 0.15E0 * pp.part + 0.1E0 * px.part + 0.05E0 * ps.part")

READINESS = PARTS + [
    f"""scores AS (
  SELECT e.employee_id, r.last_year AS year,
         {rnd(TOTAL, 4)} AS finalmatch, {rnd(f"100.0E0 * ({TOTAL})", 2)} AS finalmatch_pct,
         pc.part AS tgv_competencies, pg.part AS tgv_cognitive, pp.part AS tgv_personalitypapi,
         px.part AS tgv_context, ps.part AS tgv_behaviorstrengths
  FROM employees e JOIN last_rated r USING (employee_id)
  LEFT JOIN p_comp pc USING (employee_id)
  LEFT JOIN p_cog pg USING (employee_id)
  LEFT JOIN p_papi pp USING (employee_id)
  LEFT JOIN p_ctx px USING (employee_id)
  LEFT JOIN p_str ps USING (employee_id)
)""",
    f"""scores_ranked AS (
  SELECT *,
         CASE WHEN finalmatch_pct >= 80 THEN 'Fast Track' WHEN finalmatch_pct >= 65 THEN 'Ready'
              WHEN finalmatch_pct >= 50 THEN 'Watchlist' ELSE 'Develop' END AS readiness_category,
         CAST(DENSE_RANK() OVER (PARTITION BY year ORDER BY finalmatch DESC NULLS FIRST) AS BIGINT) AS rank_in_year,
         {rnd("100.0E0 * CUME_DIST() OVER (PARTITION BY year ORDER BY finalmatch ASC NULLS LAST)", 2)}
           AS percentile_in_year
  FROM scores
)""",
    """newest AS (SELECT * FROM scores_ranked WHERE year = (SELECT MAX(year) FROM scores_ranked))""",
]


def _part_with_year(cte: str, column: str) -> str:
    return with_mapping(*PARTS) + (f"SELECT p.employee_id, r.last_year AS year, p.part AS {column} "
                                   f"FROM {cte} p JOIN last_rated r USING (employee_id)")


# ---- high performers

HP = "hp AS (SELECT DISTINCT employee_id, year FROM performance_yearly WHERE rating = 5)"
HP_ROWS = "hp_rows AS (SELECT employee_id FROM performance_yearly WHERE rating = 5)"


def _hp_dim(table: str, key: str, label: str, distinct: bool) -> str:
    src = "hp" if distinct else "hp_rows"
    keep = "WHERE lookup.name IS NOT NULL " if distinct else ""
    return with_mapping(HP if distinct else HP_ROWS) + f"""
SELECT lookup.name AS {label}, COUNT(*) AS total_high_performers
FROM {src} JOIN employees USING (employee_id) JOIN {table} lookup USING ({key})
{keep}GROUP BY lookup.name"""


MBTI_CLEAN = f"COALESCE(NULLIF({strip_ws('pr.mbti')}, ''), 'Unknown')"

HPD_DISC = """hpd_disc AS (
  SELECT pr.disc_word AS label, COUNT(*) AS total_high_performers
  FROM hp JOIN profiles_psych pr USING (employee_id)
  WHERE pr.disc_word IS NOT NULL GROUP BY pr.disc_word
)"""
HPD_MBTI = f"""hpd_mbti AS (
  SELECT {MBTI_CLEAN} AS label, COUNT(*) AS total_high_performers
  FROM hp JOIN profiles_psych pr USING (employee_id) GROUP BY 1
)"""


def _hpd_dim_cte(name: str, table: str, key: str) -> str:
    return f"""{name} AS (
  SELECT lookup.name AS label, COUNT(*) AS total_high_performers
  FROM hp JOIN employees USING (employee_id) JOIN {table} lookup USING ({key})
  WHERE lookup.name IS NOT NULL GROUP BY lookup.name
)"""


HP_VALUES = """vals AS (
  SELECT variable, x FROM (SELECT pr.iq AS iq, pr.gtq AS gtq FROM hp JOIN profiles_psych pr USING (employee_id))
       UNPIVOT (x FOR variable IN (iq, gtq))
)"""

DESCRIBE_NUMERIC = ["company_id", "area_id", "department_id", "division_id", "directorate_id", "grade_id",
                    "education_id", "major_id", "years_of_service_months"]
DESCRIBE_TEXT = ["employee_id", "fullname", "position_id"]
RAW_EMPLOYEE_COLUMNS = ["employee_id", "fullname", "company_id", "area_id", "position_id", "department_id",
                        "division_id", "directorate_id", "grade_id", "education_id", "major_id",
                        "years_of_service_months"]


def _describe_sql() -> str:
    parts = []
    for c in DESCRIBE_NUMERIC:
        parts.append(f"""SELECT '{c}' AS column_name, COUNT({c}) AS count, CAST(NULL AS BIGINT) AS n_unique,
       CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq,
       {rnd(f"AVG({c})", 4)} AS mean, {rnd(f"STDDEV_SAMP({c})", 4)} AS std, MIN({c}) AS min,
       {rnd(f"quantile_cont({c}, 0.25)", 4)} AS p25, {rnd(f"quantile_cont({c}, 0.5)", 4)} AS p50,
       {rnd(f"quantile_cont({c}, 0.75)", 4)} AS p75, MAX({c}) AS max
FROM clean_employees""")
    for c in DESCRIBE_TEXT:
        parts.append(f"""SELECT '{c}' AS column_name, CAST(SUM(n) AS BIGINT) AS count, COUNT(*) AS n_unique,
       first(v ORDER BY n DESC, v) AS top, MAX(n) AS freq,
       CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min,
       CAST(NULL AS DOUBLE) AS p25, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p75,
       CAST(NULL AS DOUBLE) AS max
FROM (SELECT {c} AS v, COUNT(*) AS n FROM clean_employees WHERE {c} IS NOT NULL GROUP BY {c})""")
    return with_mapping(CLEAN_EMPLOYEES) + "\nUNION ALL\n".join(parts)


def _histogram_sql(bins: int = 20) -> str:
    return with_mapping(HP, HP_VALUES, f"""b AS (
  SELECT variable, CASE WHEN lo0 = hi0 THEN lo0 - 0.5E0 ELSE lo0 END AS lo,
         CASE WHEN lo0 = hi0 THEN hi0 + 0.5E0 ELSE hi0 END AS hi
  FROM (SELECT variable, MIN(x) AS lo0, MAX(x) AS hi0 FROM vals GROUP BY variable)
)""", f"""counts AS (
  SELECT v.variable, CAST(LEAST(FLOOR(((v.x - b.lo) * {bins}) / (b.hi - b.lo)), {bins - 1}) AS INTEGER) AS bin,
         COUNT(*) AS n
  FROM vals v JOIN b ON b.variable = v.variable GROUP BY 1, 2
)""", f"""grid AS (SELECT variable, lo, hi, CAST(UNNEST(range(0, {bins})) AS INTEGER) AS bin FROM b)""") + f"""
SELECT g.variable, g.bin,
       {rnd(f"g.lo + g.bin * ((g.hi - g.lo) / {bins})", 4)} AS bin_lo,
       {rnd(f"g.lo + (g.bin + 1) * ((g.hi - g.lo) / {bins})", 4)} AS bin_hi,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN counts c ON c.variable = g.variable AND c.bin = g.bin"""


def _box_sql() -> str:
    return with_mapping(HP, HP_VALUES, """q AS (
  SELECT variable, COUNT(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med,
         quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr
  FROM vals GROUP BY variable
)""") + f"""
SELECT q.variable, q.n, {rnd("q.q1", 4)} AS q1, {rnd("q.med", 4)} AS median, {rnd("q.q3", 4)} AS q3,
       {rnd("q.iqr", 4)} AS iqr,
       MIN(CASE WHEN v.x >= q.q1 - 1.5E0 * q.iqr AND v.x <= q.q3 + 1.5E0 * q.iqr THEN v.x END) AS whisker_lo,
       MAX(CASE WHEN v.x >= q.q1 - 1.5E0 * q.iqr AND v.x <= q.q3 + 1.5E0 * q.iqr THEN v.x END) AS whisker_hi,
       COUNT(CASE WHEN NOT (v.x >= q.q1 - 1.5E0 * q.iqr AND v.x <= q.q3 + 1.5E0 * q.iqr) THEN 1 END) AS n_outliers
FROM vals v JOIN q ON q.variable = v.variable
GROUP BY q.variable, q.n, q.q1, q.med, q.q3, q.iqr"""


def _top_n_sql() -> str:
    return with_mapping(
        HP,
        _hpd_dim_cte("hpd_grade", "dim_grades", "grade_id"),
        _hpd_dim_cte("hpd_division", "dim_divisions", "division_id"),
        HPD_DISC, HPD_MBTI,
    ) + """
SELECT dimension, label, total_high_performers,
       CAST(ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY total_high_performers DESC, label) AS BIGINT)
         AS rank_in_dimension
FROM (SELECT 'grade' AS dimension, label, total_high_performers, 15 AS n FROM hpd_grade
      UNION ALL SELECT 'division', label, total_high_performers, 20 FROM hpd_division
      UNION ALL SELECT 'disc', label, total_high_performers, 12 FROM hpd_disc
      UNION ALL SELECT 'mbti', label, total_high_performers, 5 FROM hpd_mbti)
QUALIFY rank_in_dimension <= n"""


def _hp_counts_sql() -> str:
    dims = [("grade", "dim_grades", "grade_id"), ("division", "dim_divisions", "division_id"), ("education", "dim_education", "education_id")]
    return with_mapping(HP, *[_hpd_dim_cte(f"hpd_{d}", table, key) for d, table, key in dims], HPD_DISC, HPD_MBTI) + """
SELECT 'year' AS dimension, CAST(year AS VARCHAR) AS label, COUNT(*) AS total_high_performers
FROM hp WHERE year IS NOT NULL GROUP BY year""" + "".join(
        f"\nUNION ALL SELECT '{d}', label, total_high_performers FROM hpd_{d}" for d in [x[0] for x in dims] + ["disc", "mbti"])


def _clean_papi_parts() -> list[str]:
    return [f"""cp0 AS (
  SELECT {strip_ws("employee_id")} AS employee_id, {strip_ws("scale_code")} AS scale_code,
         {to_number("score")} AS score
  FROM raw_papi_scores
)""", """cp1 AS (
  SELECT employee_id, scale_code,
         COALESCE(score, CASE WHEN scale_code IS NOT NULL THEN median(score) OVER (PARTITION BY scale_code) END) AS score
  FROM cp0
)""", """SELECT employee_id, scale_code, COALESCE(score, median(score) OVER ()) AS score FROM cp1"""]


def _clean_papi_sql() -> str:
    *ctes, tail = _clean_papi_parts()
    return with_mapping(*ctes) + tail


def _clean_profiles_parts() -> list[str]:
    nums = ["pauli", "faxtor", "iq", "gtq", "tiki"]
    conv = ", ".join(f"{to_number(c)} AS {c}" for c in nums)
    fill = ", ".join(f"COALESCE({c}, median({c}) OVER ()) AS {c}" for c in nums)
    return [f"p0 AS (SELECT employee_id, {conv}, disc, disc_word, mbti FROM raw_profiles_psych)", f"""
SELECT employee_id, {fill}, {fill_disc("disc", "disc_word")} AS disc,
       COALESCE({known("disc_word")}, 'Unknown') AS disc_word, COALESCE({known("mbti")}, 'Unknown') AS mbti
FROM p0"""]


def _clean_profiles_sql() -> str:
    *ctes, tail = _clean_profiles_parts()
    return with_mapping(*ctes) + tail


def _dq_missing_sql() -> str:
    parts = [f"SELECT '{c}' AS column_name, CAST(COUNT_IF({known(c)} IS NULL) AS BIGINT) AS n_missing "
             f"FROM raw_employees" for c in RAW_EMPLOYEE_COLUMNS]
    return with_mapping() + "\nUNION ALL\n".join(parts)


def _created_ranked_sql() -> str:
    ctes = [CREATED] + match_ctes(bench="created")
    return with_mapping(*ctes) + "\n" + top_per_job(
        50, "(SELECT * FROM people_ranked WHERE job_vacancy_id = (SELECT MAX(job_vacancy_id) FROM created))")


def _refreshed_ranked_sql() -> str:
    ctes = [UPDATED, "one AS (SELECT * FROM updated WHERE job_vacancy_id = 1)"] + match_ctes(bench="one")
    return with_mapping(*ctes) + "\n" + top_per_job(50)


def _evidence_sql() -> str:
    return with_mapping(*MATCH, f"""job_groups AS (
  SELECT job_vacancy_id, tgv_name,
         ROW_NUMBER() OVER (PARTITION BY job_vacancy_id ORDER BY avg_tgv_match DESC NULLS LAST, tgv_name) AS pos,
         COUNT(*) OVER (PARTITION BY job_vacancy_id) AS n
  FROM (SELECT job_vacancy_id, tgv_name, {rnd("AVG(tgv_match_rate)", 2)} AS avg_tgv_match
        FROM detail WHERE job_vacancy_id IS NOT NULL GROUP BY 1, 2)
)""", """best AS (
  SELECT job_vacancy_id, MAX(tgv_name) FILTER (WHERE pos = 1) AS tgv_best, MAX(tgv_name) FILTER (WHERE pos = n) AS tgv_gap
  FROM job_groups GROUP BY 1
)""", """tv_pos AS (
  SELECT job_vacancy_id, employee_id, tv_name, tv_match_rate,
         ROW_NUMBER() OVER (PARTITION BY job_vacancy_id, employee_id ORDER BY tv_match_rate DESC NULLS LAST, tv_name) AS hi,
         ROW_NUMBER() OVER (PARTITION BY job_vacancy_id, employee_id ORDER BY tv_match_rate ASC NULLS LAST, tv_name) AS lo
  FROM detail WHERE job_vacancy_id IS NOT NULL
)""", """lists AS (
  SELECT job_vacancy_id, employee_id,
         list({'tv_name': tv_name, 'tv_match_rate': tv_match_rate} ORDER BY hi) FILTER (WHERE hi <= 5) AS top,
         list({'tv_name': tv_name, 'tv_match_rate': tv_match_rate} ORDER BY lo) FILTER (WHERE lo <= 5) AS low
  FROM tv_pos GROUP BY 1, 2
)""") + """
SELECT l.job_vacancy_id, l.employee_id,
       CAST(to_json({'job_vacancy_id': l.job_vacancy_id, 'tgv_best': b.tgv_best, 'tgv_gap': b.tgv_gap,
                     'candidate_id': l.employee_id, 'candidate_top_tvs': l.top, 'candidate_low_tvs': l.low})
            AS VARCHAR) AS evidence
FROM lists l JOIN best b USING (job_vacancy_id)"""


def _from_raw(ctes: list[str], tail: str) -> str:
    """The same model over the cleaned tables instead of the typed ones."""
    def cleaned(sql: str) -> str:
        for name, clean in (("performance_yearly", "clean_performance"), ("competencies_yearly", "clean_competencies"),
                            ("profiles_psych", "clean_profiles"), ("papi_scores", "clean_papi"), ("last_rated", "clean_last_rated")):
            sql = re.sub(rf"\b{name}\b", clean, sql)
        return sql

    papi, profiles = _clean_papi_parts(), _clean_profiles_parts()
    last = "clean_last_rated AS (SELECT employee_id, MAX(year) AS last_year FROM clean_performance GROUP BY employee_id)"
    return with_mapping(CLEAN_PERFORMANCE, CLEAN_COMPETENCIES, *papi[:-1], f"clean_papi AS ({papi[-1]})", *profiles[:-1],
                        f"clean_profiles AS ({profiles[-1]})", last, *[cleaned(c) for c in ctes]) + tail


ORACLE: dict[str, str] = {
    # raw to clean to score
    "readiness_from_raw": _from_raw(READINESS, "SELECT * FROM scores"),
    "match_from_raw": _from_raw(MATCH[:6], "SELECT employee_id, job_vacancy_id, final_rate AS final_match_rate FROM finals"),
    # benchmarks
    "benchmark_create": with_mapping(CREATED) + f"""
SELECT s.*, c.role_name, c.job_level, strftime(c.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM ({cohort_summary("created")}) s JOIN created c USING (job_vacancy_id)""",
    "benchmark_set_cohort": with_mapping(UPDATED) + cohort_summary("updated"),
    "benchmark_recent": with_mapping(CREATED) + """
SELECT job_vacancy_id, role_name, job_level, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM created ORDER BY job_vacancy_id DESC LIMIT 25""",
    "employee_directory": with_mapping() + """
SELECT fullname || ' (' || employee_id || ')' AS label, employee_id, fullname FROM employees""",
    "cohort_candidates": with_mapping() + "SELECT employee_id FROM top_rated ORDER BY employee_id LIMIT 20",
    "cohort_explode": with_mapping() + """
SELECT job_vacancy_id, UNNEST(selected_talent_ids) AS employee_id FROM talent_benchmarks""",
    # cleaning
    "clean_numeric_coerce": with_mapping(CLEAN_EMPLOYEES) + "SELECT * FROM clean_employees",
    "clean_performance": with_mapping(CLEAN_PERFORMANCE) + "SELECT * FROM clean_performance",
    "raw_rejects": with_mapping() + """
SELECT n_fields = 4 AS fits, n_fields, COUNT(*) AS n_rows, COUNT(DISTINCT employee_id) AS n_people
FROM (SELECT employee_id, CASE WHEN right(employee_id, 1) = '7' THEN 3 WHEN right(employee_id, 2) = '13' THEN 5 ELSE 4 END AS n_fields
      FROM raw_competencies_yearly)
GROUP BY n_fields""",
    "clean_competencies": with_mapping(CLEAN_COMPETENCIES) + "SELECT * FROM clean_competencies",
    "clean_profiles": _clean_profiles_sql(),
    "clean_disc": with_mapping() + f"""
SELECT employee_id, disc, disc_word, {fill_disc("disc", "disc_word")} AS disc_filled FROM raw_profiles_psych""",
    "clean_papi": _clean_papi_sql(),
    # quality
    "dq_missing": _dq_missing_sql(),
    "dq_missing_before_after": with_mapping(CLEAN_COMPETENCIES) + f"""
SELECT {rnd(f"(SELECT AVG(CAST({to_number('score')} IS NULL AS DOUBLE)) FROM raw_competencies_yearly)", 4)}
         AS missing_before,
       {rnd("(SELECT AVG(CAST(score IS NULL AS DOUBLE)) FROM clean_competencies)", 4)} AS missing_after""",
    "dq_duplicates": with_mapping(CLEAN_COMPETENCIES) + """
SELECT * FROM clean_competencies
QUALIFY COUNT(*) OVER (PARTITION BY employee_id, year, pillar_code) > 1""",
    "dq_key_uniqueness": with_mapping() + """
SELECT COUNT(DISTINCT employee_id) AS n_unique, COUNT(*) AS n_rows FROM raw_employees""",
    "dq_range": with_mapping(CLEAN_EMPLOYEES) + """
SELECT employee_id, fullname, years_of_service_months FROM clean_employees
WHERE NOT (years_of_service_months BETWEEN 0 AND 600)""",
    "dq_missing_fk": with_mapping(CLEAN_EMPLOYEES) + """
SELECT employee_id, fullname FROM clean_employees WHERE grade_id IS NULL""",
    "dq_describe": _describe_sql(),
    # EDA
    "latest_year": with_mapping() + "SELECT employee_id, last_year AS latest_year FROM last_rated",
    "hp_by_year": with_mapping(HP_ROWS.replace("SELECT employee_id", "SELECT year")) + """
SELECT year, COUNT(*) AS total_high_performers FROM hp_rows GROUP BY year""",
    "hp_by_grade": _hp_dim("dim_grades", "grade_id", "grade_name", False),
    "hp_by_division": _hp_dim("dim_divisions", "division_id", "division_name", False),
    "hp_by_education": _hp_dim("dim_education", "education_id", "education_level", False),
    "hp_by_disc": with_mapping(HP_ROWS) + """
SELECT pr.disc_word AS disc_profile, COUNT(*) AS total_high_performers
FROM hp_rows JOIN profiles_psych pr USING (employee_id) GROUP BY pr.disc_word""",
    "hp_by_mbti": with_mapping(HP_ROWS) + """
SELECT COALESCE(NULLIF(TRIM(pr.mbti), ''), 'Unknown') AS mbti, COUNT(*) AS total_high_performers
FROM hp_rows JOIN profiles_psych pr USING (employee_id) GROUP BY 1""",
    "iq_gtq_summary": with_mapping() + f"""
SELECT {rnd("AVG(iq)", 2)} AS avg_iq, {rnd("AVG(gtq)", 2)} AS avg_gtq, MIN(iq) AS min_iq, MAX(iq) AS max_iq,
       MIN(gtq) AS min_gtq, MAX(gtq) AS max_gtq FROM profiles_psych""",
    "tiki_summary": with_mapping() + f"""
SELECT {rnd("AVG(tiki)", 2)} AS avg_tiki, MIN(tiki) AS min_tiki, MAX(tiki) AS max_tiki FROM profiles_psych""",
    "pillar_avg_latest": with_mapping() + f"""
SELECT c.pillar_code, d.pillar_label, {rnd("AVG(c.score)", 2)} AS avg_score
FROM competencies_yearly c JOIN last_rated r USING (employee_id) JOIN dim_competency_pillars d USING (pillar_code)
WHERE c.year = r.last_year
GROUP BY c.pillar_code, d.pillar_label""",
    "pillar_vs_rating": with_mapping("""latest_pairs AS (
  SELECT c.pillar_code, c.score, y.rating
  FROM competencies_yearly c JOIN last_rated r USING (employee_id)
  JOIN performance_yearly y ON y.employee_id = c.employee_id AND y.year = r.last_year
  WHERE c.year = r.last_year
)""") + f"""
SELECT d.pillar_label, {rnd("AVG(lp.score)", 2)} AS avg_competency_score,
       {rnd("AVG(lp.rating)", 2)} AS avg_performance_rating
FROM latest_pairs lp JOIN dim_competency_pillars d USING (pillar_code)
GROUP BY d.pillar_label""",
    "high_performers": with_mapping(HP) + "SELECT * FROM hp",
    "hpd_by_year": with_mapping(HP) + "SELECT year, COUNT(*) AS total_high_performers FROM hp GROUP BY year",
    "hpd_by_grade": _hp_dim("dim_grades", "grade_id", "grade_name", True),
    "hpd_by_division": _hp_dim("dim_divisions", "division_id", "division_name", True),
    "hpd_by_education": _hp_dim("dim_education", "education_id", "education_level", True),
    "hpd_by_disc": with_mapping(HP, HPD_DISC) + "SELECT label AS disc_word, total_high_performers FROM hpd_disc",
    "hpd_by_mbti": with_mapping(HP, HPD_MBTI) + "SELECT label AS mbti_clean, total_high_performers FROM hpd_mbti",
    "hp_iq_gtq_summary": with_mapping(HP) + f"""
SELECT {rnd_even("AVG(pr.iq)", 2)} AS avg_iq, {rnd_even("AVG(pr.gtq)", 2)} AS avg_gtq,
       MIN(pr.iq) AS min_iq, MAX(pr.iq) AS max_iq, MIN(pr.gtq) AS min_gtq, MAX(pr.gtq) AS max_gtq
FROM hp JOIN profiles_psych pr USING (employee_id)""",
    "hp_tiki_summary": with_mapping(HP) + f"""
SELECT {rnd_even("AVG(pr.tiki)", 2)} AS avg_tiki, MIN(pr.tiki) AS min_tiki, MAX(pr.tiki) AS max_tiki
FROM hp JOIN profiles_psych pr USING (employee_id)""",
    "hp_pillar_avg": with_mapping(HP) + f"""
SELECT c.pillar_code, d.pillar_label, {rnd_even("AVG(c.score)", 2)} AS avg_score
FROM competencies_yearly c SEMI JOIN hp ON hp.employee_id = c.employee_id AND hp.year = c.year
JOIN dim_competency_pillars d USING (pillar_code)
WHERE d.pillar_label IS NOT NULL GROUP BY c.pillar_code, d.pillar_label""",
    "hp_pillar_vs_rating": with_mapping(HP) + f"""
SELECT d.pillar_label, {rnd_even("AVG(c.score)", 2)} AS avg_competency_score,
       {rnd_even("AVG(y.rating)", 2)} AS avg_performance_rating
FROM competencies_yearly c SEMI JOIN hp ON hp.employee_id = c.employee_id AND hp.year = c.year
LEFT JOIN performance_yearly y ON y.employee_id = c.employee_id AND y.year = c.year
JOIN dim_competency_pillars d USING (pillar_code)
WHERE d.pillar_label IS NOT NULL GROUP BY d.pillar_label""",
    "hp_counts": _hp_counts_sql(),
    "hp_top_n": _top_n_sql(),
    "score_histogram": _histogram_sql(),
    "score_box_stats": _box_sql(),
    # readiness
    "tgv_competencies": with_mapping(*PARTS) + """
SELECT p.employee_id, r.last_year AS year, p.comp_avg, p.part AS tgv_competencies
FROM p_comp p JOIN last_rated r USING (employee_id)""",
    "tgv_cognitive": _part_with_year("p_cog", "tgv_cognitive"),
    "tgv_personality": _part_with_year("p_papi", "tgv_personalitypapi"),
    "tgv_context": _part_with_year("p_ctx", "tgv_context"),
    "tgv_strengths": _part_with_year("p_str", "tgv_behaviorstrengths"),
    "readiness_final": with_mapping(*READINESS) + "SELECT * FROM scores",
    "readiness_ranked": with_mapping(*READINESS) + "SELECT * FROM scores_ranked",
    "shortlist_top3": with_mapping(*READINESS) + """
SELECT d.name AS division_name, s.employee_id, s.year, s.finalmatch_pct, s.readiness_category,
       CAST(ROW_NUMBER() OVER (PARTITION BY e.division_id, s.year
                               ORDER BY s.finalmatch DESC NULLS FIRST, s.employee_id) AS BIGINT) AS rank_in_division
FROM scores_ranked s JOIN employees e USING (employee_id) JOIN dim_divisions d USING (division_id)
QUALIFY rank_in_division <= 3""",
    "readiness_latest": with_mapping(*READINESS) + f"""
SELECT year, readiness_category, COUNT(*) AS n_employees,
       {rnd("COUNT(*) * 100.0E0 / SUM(COUNT(*)) OVER ()", 2)} AS pct_of_total
FROM newest GROUP BY year, readiness_category""",
    "readiness_by_year": with_mapping(*READINESS) + f"""
SELECT year, readiness_category, COUNT(*) AS n_employees,
       {rnd("COUNT(*) * 100.0E0 / SUM(COUNT(*)) OVER (PARTITION BY year)", 2)} AS pct_of_total
FROM scores_ranked GROUP BY year, readiness_category""",
    "readiness_by_division": with_mapping(*READINESS) + f"""
SELECT d.name AS division_name, n.readiness_category, COUNT(*) AS n_employees,
       {rnd("COUNT(*) * 100.0E0 / SUM(COUNT(*)) OVER (PARTITION BY d.name)", 2)} AS pct_within_division
FROM newest n JOIN employees e USING (employee_id) JOIN dim_divisions d USING (division_id)
GROUP BY d.name, n.readiness_category""",
    # match
    "tv_long": with_mapping(traits()) + f"""
SELECT employee_id, tgv_name, tv_name, {rnd("user_score", 4)} AS user_score, direction FROM traits""",
    "match_baseline": with_mapping(*MATCH[:3]) + "SELECT * FROM medians",
    "match_tv": trimmed(MATCH[:4], f"""
SELECT employee_id, job_vacancy_id, tgv_name, tv_name, {rnd("baseline_score", 2)} AS baseline_score,
       {rnd("user_score", 2)} AS user_score, {rnd("tv_rate", 2)} AS tv_match_rate FROM rated"""),
    "match_tgv": with_mapping(*MATCH[:5]) + f"""
SELECT DISTINCT employee_id, job_vacancy_id, tgv_name, {rnd("tgv_rate", 2)} AS tgv_match_rate FROM grouped""",
    "match_final": with_mapping(*MATCH[:6]) + "SELECT employee_id, job_vacancy_id, final_rate AS final_match_rate FROM finals",
    "match_final_no_tiki": with_mapping(*match_ctes(include_tiki=False)[:6]) + """
SELECT employee_id, job_vacancy_id, final_rate AS final_match_rate FROM finals""",
    "benchmark_matching": with_mapping(*MATCH) + """
SELECT * EXCLUDE (fullname) FROM detail""",
    "match_detail_top": with_mapping(*MATCH) + """
SELECT * EXCLUDE (job_vacancy_id) FROM detail WHERE job_vacancy_id = 1
ORDER BY final_match_rate DESC NULLS FIRST, employee_id, tgv_name, tv_name LIMIT 500""",
    # insight
    "ranked_talent": with_mapping(*MATCH) + "SELECT * FROM people_ranked",
    "ranked_talent_all": with_mapping(*MATCH) + """
SELECT job_vacancy_id, employee_id, fullname, directorate, role, grade, MAX(final_match_rate) AS final_match_rate
FROM detail WHERE job_vacancy_id IS NOT NULL GROUP BY ALL""",
    "ranked_talent_top50": with_mapping(*MATCH) + top_per_job(50),
    "benchmark_create_ranked": _created_ranked_sql(),
    "benchmark_refresh_ranked": _refreshed_ranked_sql(),
    "match_distribution": with_mapping(*MATCH, f"top100 AS ({top_per_job(100)})") + """
SELECT job_vacancy_id, CAST(FLOOR(final_match_rate / 10.0E0) * 10.0E0 AS DOUBLE) AS bucket_lo,
       COUNT(*) AS n_candidates
FROM top100 GROUP BY 1, 2""",
    "candidate_tv_bands": with_mapping(*MATCH) + """
SELECT job_vacancy_id, employee_id, tv_name, baseline_score, user_score, tv_match_rate,
       CASE WHEN tv_match_rate >= 90 THEN 'green' WHEN tv_match_rate >= 70 THEN 'amber' ELSE 'red' END AS match_band
FROM detail WHERE job_vacancy_id IS NOT NULL""",
    "candidate_tgv_profile": with_mapping(*MATCH) + f"""
SELECT job_vacancy_id, employee_id, tgv_name, {rnd("AVG(tgv_match_rate)", 2)} AS tgv_match_rate,
       100.0E0 AS benchmark_rate
FROM detail WHERE job_vacancy_id IS NOT NULL GROUP BY 1, 2, 3""",
    "candidate_insight": with_mapping(*MATCH, f"""prof AS (
  SELECT job_vacancy_id, employee_id, tgv_name, {rnd("AVG(tgv_match_rate)", 2)} AS r
  FROM detail WHERE job_vacancy_id IS NOT NULL GROUP BY 1, 2, 3
)""") + """
SELECT job_vacancy_id, employee_id,
       first(tgv_name ORDER BY r DESC, tgv_name) FILTER (WHERE r IS NOT NULL) AS best_tgv,
       first(tgv_name ORDER BY r ASC, tgv_name) FILTER (WHERE r IS NOT NULL) AS worst_tgv,
       COALESCE(string_agg(tgv_name, ',' ORDER BY tgv_name) FILTER (WHERE r >= 85), '') AS strong_tgvs,
       COALESCE(string_agg(tgv_name, ',' ORDER BY tgv_name) FILTER (WHERE r <= 70), '') AS weak_tgvs
FROM prof GROUP BY 1, 2""",
    "job_tgv_summary": with_mapping(*MATCH, f"""s AS (
  SELECT job_vacancy_id, tgv_name, {rnd("AVG(tgv_match_rate)", 2)} AS avg_tgv_match
  FROM detail WHERE job_vacancy_id IS NOT NULL GROUP BY 1, 2
)""") + """
SELECT job_vacancy_id, tgv_name, avg_tgv_match, tgv_rank, tgv_rank = 1 AS is_best, tgv_rank = n AS is_worst
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY job_vacancy_id ORDER BY avg_tgv_match DESC NULLS LAST, tgv_name)
                     AS BIGINT) AS tgv_rank,
             COUNT(*) OVER (PARTITION BY job_vacancy_id) AS n FROM s)""",
    "candidate_top_bottom_tvs": with_mapping(*MATCH) + """
SELECT job_vacancy_id, employee_id, 'top' AS side,
       CAST(ROW_NUMBER() OVER (PARTITION BY job_vacancy_id, employee_id ORDER BY tv_match_rate DESC NULLS LAST, tv_name)
            AS BIGINT) AS position, tv_name, tv_match_rate
FROM detail WHERE job_vacancy_id IS NOT NULL QUALIFY position <= 5
UNION ALL
SELECT job_vacancy_id, employee_id, 'low' AS side,
       CAST(ROW_NUMBER() OVER (PARTITION BY job_vacancy_id, employee_id ORDER BY tv_match_rate ASC NULLS LAST, tv_name)
            AS BIGINT) AS position, tv_name, tv_match_rate
FROM detail WHERE job_vacancy_id IS NOT NULL QUALIFY position <= 5""",
    "candidate_evidence_json": _evidence_sql(),
}

# Queries checked on row counts only (none at present).
ROWS_ONLY: list[str] = []
