"""Explicit schemas of the talent tables (no inference at read time)."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, I, D = StringType(), IntegerType(), DoubleType()

EMPLOYEES = _s(
    ("employee_id", S), ("fullname", S), ("company_id", I), ("area_id", I), ("position_id", S),
    ("department_id", I), ("division_id", I), ("directorate_id", I), ("grade_id", I),
    ("education_id", I), ("major_id", I), ("years_of_service_months", D),
)
PERFORMANCE_YEARLY = _s(("employee_id", S), ("year", I), ("rating", D))
COMPETENCIES_YEARLY = _s(("employee_id", S), ("year", I), ("pillar_code", S), ("score", D))
PROFILES_PSYCH = _s(
    ("employee_id", S), ("pauli", D), ("faxtor", D), ("iq", D), ("gtq", D), ("tiki", D),
    ("disc", S), ("disc_word", S), ("mbti", S),
)
PAPI_SCORES = _s(("employee_id", S), ("scale_code", S), ("score", D))
STRENGTHS = _s(("employee_id", S), ("theme", S), ("rank", I))
DIM_GRADES = _s(("grade_id", I), ("name", S))
DIM_DIVISIONS = _s(("division_id", I), ("name", S))
DIM_EDUCATION = _s(("education_id", I), ("name", S))
DIM_DIRECTORATES = _s(("directorate_id", I), ("name", S))
DIM_POSITIONS = _s(("position_id", S), ("name", S))
DIM_COMPETENCY_PILLARS = _s(("pillar_code", S), ("pillar_label", S))
TALENT_BENCHMARKS = _s(
    ("job_vacancy_id", I), ("role_name", S), ("job_level", S), ("role_purpose", S),
    ("selected_talent_ids", ArrayType(S)), ("weights_config", S), ("created_at", TimestampNTZType()),
)

TABLE_SCHEMAS: dict[str, StructType] = {
    "employees": EMPLOYEES,
    "performance_yearly": PERFORMANCE_YEARLY,
    "competencies_yearly": COMPETENCIES_YEARLY,
    "profiles_psych": PROFILES_PSYCH,
    "papi_scores": PAPI_SCORES,
    "strengths": STRENGTHS,
    "dim_grades": DIM_GRADES,
    "dim_divisions": DIM_DIVISIONS,
    "dim_education": DIM_EDUCATION,
    "dim_directorates": DIM_DIRECTORATES,
    "dim_positions": DIM_POSITIONS,
    "dim_competency_pillars": DIM_COMPETENCY_PILLARS,
    "talent_benchmarks": TALENT_BENCHMARKS,
}


def all_strings(schema: StructType) -> StructType:
    """Same column names, every column a string: how raw exports arrive."""
    return StructType([StructField(f.name, S, True) for f in schema.fields])
