"""Column -> Column helpers built from native Spark expressions (no UDFs)."""

from talentscope.functions.numeric import (
    NUMBER_PATTERN,
    min_max_scale,
    rnd,
    rnd_even,
    safe_div,
    strip_ws,
    to_number,
)
from talentscope.functions.scoring import (
    TGV_NAMES,
    TGV_WEIGHTS,
    match_band,
    readiness_band,
    tv_match_rate,
    weighted_sum,
)
from talentscope.functions.text import (
    blank_to_unknown,
    disc_from_words,
    fill_disc,
    missing_to_unknown,
    column_names,
)

__all__ = [
    "NUMBER_PATTERN",
    "TGV_NAMES",
    "TGV_WEIGHTS",
    "blank_to_unknown",
    "disc_from_words",
    "fill_disc",
    "match_band",
    "min_max_scale",
    "missing_to_unknown",
    "column_names",
    "readiness_band",
    "rnd",
    "rnd_even",
    "safe_div",
    "strip_ws",
    "to_number",
    "tv_match_rate",
    "weighted_sum",
]
