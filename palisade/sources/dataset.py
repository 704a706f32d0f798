"""Dictionaries of phrases: patterns, allowed exceptions and metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.patterns import BlacklistedTerm, ParsedPattern, assign_incrementing_ids, pattern


@dataclass(frozen=True)
class PhraseContainer:
    """Patterns with the texts they come from, allowed texts and metadata of one phrase."""

    metadata: Any = None
    patterns: tuple[tuple[str, ParsedPattern], ...] = ()
    whitelisted_terms: tuple[str, ...] = ()


@dataclass(frozen=True)
class PhraseBuilder:
    """Collects a phrase; every method returns a new builder."""

    phrase: PhraseContainer = PhraseContainer()

    def add_pattern(self, source: str | ParsedPattern) -> PhraseBuilder:
        pair = (source, pattern(source)) if isinstance(source, str) else ("", source)
        return PhraseBuilder(replace(self.phrase, patterns=(*self.phrase.patterns, pair)))

    def add_whitelisted_term(self, term: str) -> PhraseBuilder:
        return PhraseBuilder(replace(self.phrase, whitelisted_terms=(*self.phrase.whitelisted_terms, term)))

    def set_metadata(self, metadata: Any) -> PhraseBuilder:
        return PhraseBuilder(replace(self.phrase, metadata=metadata))

    def build(self) -> PhraseContainer:
        return self.phrase


@dataclass(frozen=True)
class DataSet:
    """An ordered bag of phrases; term ids count all patterns in order. Methods return a new dataset."""

    phrases: tuple[PhraseContainer, ...] = ()

    def add_all(self, other: DataSet) -> DataSet:
        return DataSet(self.phrases + other.phrases)

    def remove_phrases_if(self, predicate: Callable[[PhraseContainer], bool]) -> DataSet:
        return DataSet(tuple(p for p in self.phrases if not predicate(p)))

    def add_phrase(self, build: Callable[[PhraseBuilder], PhraseBuilder]) -> DataSet:
        return DataSet((*self.phrases, build(PhraseBuilder()).build()))

    def build(self) -> dict[str, list]:
        """``blacklisted_terms`` and ``whitelisted_terms``, as a matcher takes them."""
        terms = assign_incrementing_ids(p for phrase in self.phrases for _, p in phrase.patterns)
        return {"blacklisted_terms": terms, "whitelisted_terms": [w for p in self.phrases for w in p.whitelisted_terms]}

    def _rows(self) -> Iterable[tuple[int, int, str, str | None]]:
        owners = ((k, source, p.metadata) for k, p in enumerate(self.phrases) for source, _ in p.patterns)
        for i, (k, source, metadata) in enumerate(owners):
            yield i, k, source, None if metadata is None else str(metadata)

    def terms(self, spark: SparkSession) -> DataFrame:
        """(term_id, phrase_id, pattern, metadata), a row per pattern."""
        return spark.createDataFrame(list(self._rows()), "term_id int, phrase_id int, pattern string, metadata string")

    def phrase_metadata(self, term_id: int) -> Any:
        owners = [p for p in self.phrases for _ in p.patterns]
        if not 0 <= term_id < len(owners):
            raise KeyError(f"The pattern with ID {term_id} does not exist in this dataset.")
        return owners[term_id].metadata

    def with_metadata(self, matches: DataFrame) -> DataFrame:
        """Adds ``phrase_metadata`` to rows with a ``term_id``; an id that the dataset lacks fails the query.

        The dictionary is part of the program, so it is small and sent to every task.
        """
        known = self.terms(matches.sparkSession).select(F.col("term_id").alias("_id"), F.col("metadata").alias("phrase_metadata"))
        text = F.concat(F.lit("The pattern with ID "), F.col("term_id").cast("string"), F.lit(" does not exist in this dataset."))
        joined = matches.join(F.broadcast(known), F.col("term_id") == F.col("_id"), "left")
        found = F.when(F.col("_id").isNull(), F.raise_error(text).cast("string")).otherwise(F.col("phrase_metadata"))
        return joined.withColumn("phrase_metadata", found).drop("_id")


def terms_of(patterns: Iterable[str]) -> list[BlacklistedTerm]:
    return assign_incrementing_ids(pattern(p) for p in patterns)
