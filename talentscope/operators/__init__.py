"""DataFrame -> DataFrame operators, grouped by the question they answer."""

from talentscope.operators import (
    benchmark,
    clean,
    common,
    eda,
    insight,
    match,
    quality,
    ranking,
    readiness,
)

__all__ = ["benchmark", "clean", "common", "eda", "insight", "match", "quality", "ranking", "readiness"]
