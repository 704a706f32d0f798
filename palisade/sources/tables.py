"""Reading tables and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, path: str) -> DataFrame:
    """(word), trimmed, from a text file with a word per line."""
    return spark.read.text(path).select(F.trim("value").alias("word"))


def search_words(df: DataFrame, query: str, column: str = "word") -> DataFrame:
    """Rows whose word starts with ``x`` for ``^x``, ends with it for ``x$``, and holds it otherwise.

    With both anchors only the start is tested.
    """
    query = query.strip()
    start, end = query.startswith("^"), query.endswith("$")
    query = query[1:] if start else query
    query = query.removesuffix("$")
    word = F.col(column)
    return df.where(word.startswith(query) if start else word.endswith(query) if end else word.contains(query))
