"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_texts, slices
from .rules import COMMON, MARKS

_FREQUENT = frozenset(w.encode() for w in COMMON)
_SORTS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", MARKS.replace("!", "").encode(), b"!", b"|", b"#*$%&<>@^~=+_{}[]\\/`", b" \t\n\x0b\x0c\r")
_SORT = np.full(256, len(_SORTS), np.intp)
for _k, _chars in enumerate(_SORTS):
    _SORT[list(_chars)] = _k
N_FEATURES = 16
#: About so many labelled rows at most are learnt from; the moments of 16 statistics need far fewer.
SAMPLE = 20_000


def _logit(share: float) -> float:
    share = min(max(share, 0.0), 1.0)
    return math.log((share + 1e-3) / (1.001 - share))


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one UTF-8 text: logarithms of sizes and logits of shares."""
    kinds = np.bincount(_SORT, np.bincount(np.frombuffer(text, np.uint8), minlength=256), len(_SORTS) + 1).tolist()
    n, words = max(1.0, float(len(text)) - kinds[7]), text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    triples = max(1, len(words) - 2)
    return [
        math.log1p(len(words)), math.log1p(lengths.mean()), math.log1p(lengths.std()),
        *(_logit(kinds[k] / n) for k in (1, 2, 3, 4, 5, 6, 8)),
        _logit(len(set(words)) / m), _logit(1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if len(words) > 2 else 0.0),
        _logit(1 - len(set(lines)) / max(1, len(lines))), math.log1p(len(words) / max(1, len(lines))),
        _logit(sum(map(_FREQUENT.__contains__, words)) / m), _logit(sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines))),
    ]


@dataclass(frozen=True)
class QualityModel:
    """Class means, inverted Cholesky factors, half log determinants and log priors; index 1 is good quality."""

    means: np.ndarray
    whiten: np.ndarray
    half_logdet: np.ndarray
    log_prior: np.ndarray
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        if not len(self.means):
            return np.full(len(x), float(np.exp(self.log_prior[1])))
        density = [p - h - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, h, p in zip(self.means, self.whiten, self.half_logdet, self.log_prior, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / self.temperature, -60, 60)))


def _model(n: np.ndarray, sums: np.ndarray, outer: np.ndarray, pooled: float, ridge: float, temperature: float) -> QualityModel:
    log_prior = np.log((n + 1) / (n.sum() + 2))
    if n.min() < 2:  # nothing to tell the classes apart by
        return QualityModel(np.zeros((0, N_FEATURES)), np.zeros((0, 0)), np.zeros(0), log_prior, temperature)
    means = sums / n[:, None]
    covs = outer / n[:, None, None] - means[:, :, None] * means[:, None, :]
    within = np.tensordot(n / n.sum(), covs, axes=1)
    floor = ridge * np.diag(np.diag(within) + 1e-6)
    covs = (1 - pooled) * covs + pooled * within + floor
    factors = np.linalg.cholesky(covs)
    return QualityModel(means, np.linalg.inv(factors), np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1), log_prior, temperature)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def labelled(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, y) to learn from: no rows that are held out, of documents with several labels the lowest.

    Of more than ``most`` those with the lowest hashes are taken, about ``most``, so that what is broadcast is bounded.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.min("y").alias("y"))
    n = known.count()
    return known if n <= most else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def fit(docs: DataFrame, labels: DataFrame, pooled: float = 0.1, ridge: float = 0.05, temperature: float = 2.0, most: int = SAMPLE) -> QualityModel:
    """Fits on the rows of ``docs`` (doc_id, text) that ``labelled`` names; null texts count as empty.

    ``labels`` (doc_id, quality) may miss or repeat documents; null labels are left out. Statistics are computed of the
    labelled rows only and reduced to sums on the executors; moments, a fixed number of values, reach the driver.
    """
    rows = _few(docs).join(F.broadcast(labelled(labels, most)), "doc_id").select("text", "y")
    size = 1 + N_FEATURES + N_FEATURES**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for whole in batches:
            for batch in slices(whole):
                x, y = _matrix(binary_texts(batch)), batch.column("y").to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    own = x[y == k]
                    total[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size), pa.int32()), pa.array(np.tile(np.arange(size), 2), pa.int32()), pa.array(total.ravel())], ["y", "i", "v"])

    total = np.zeros((2, size))
    for r in rows.mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        total[r["y"], r["i"]] = r["v"]
    n, sums, outer = total[:, 0], total[:, 1 : 1 + N_FEATURES], total[:, 1 + N_FEATURES :].reshape(2, N_FEATURES, N_FEATURES)
    return _model(n, sums, outer, pooled, ridge, temperature)


def _few(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, N_FEATURES)


def text_score(model: QualityModel, text: str = "text") -> Column:
    """The score of a text column; null texts count as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([texts], ["text"])
        return pa.array(np.concatenate([np.zeros(0), *(model.score(_matrix(binary_texts(b))) for b in slices(whole))]))

    return score(F.col(text).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text); other columns are ignored.

    Null and empty texts get a score as well. Without at least two labelled rows of either class every score is the
    share of good labels. A null doc_id is never held out and never labelled.
    """
    scored = _few(docs).select("doc_id", held_out().alias("held_out"), text_score(fit(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``."""
    return docs.where(text_score(fit(docs, labels)) >= threshold)


def labels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality(spark, sf_dir):
    from .common import documents

    return classify(documents(spark, sf_dir), labels_table(spark, sf_dir))
