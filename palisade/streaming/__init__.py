"""Moderation of streams: matching and censoring are row-local, so the batch plan runs on a stream as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.censor import TextCensor
from ..operators.matcher import Matcher


def moderate(df: DataFrame, matcher: Matcher, censor: TextCensor | None = None, text: str = "text") -> DataFrame:
    """Adds ``matches`` and ``censored`` to a batch or streaming frame; no shuffle, no state."""
    found = df.withColumn("matches", matcher.matches(F.col(text), sorted=True))
    return found.withColumn("censored", (censor or TextCensor()).apply_to(F.col(text), F.col("matches")))
