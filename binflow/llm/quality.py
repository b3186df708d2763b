"""Quality scores by regularised quadratic discriminant analysis.

Each document becomes a row of transformed text statistics. A class has a mean and a
covariance, shrunk towards the pooled covariance and towards its own diagonal; a document's
score is the difference of the two log densities, through Cholesky factors computed once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.llm.common import fold_of, query, stored, table

#: Shrinkage of a class covariance towards the pooled one, and towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.2, 0.1
#: Added to every variance.
FLOOR = 1e-3

STATISTICS = (
    "chars", "words", "word_length", "letters", "upper", "digits", "stops", "symbols", "distinct", "top_word", "lines", "line_length", "same_lines", "long_words", "capitals", "marked_words",
)
FEATURES = tuple(f"f{i}" for i in range(len(STATISTICS)))


def _kinds() -> np.ndarray:
    """letters 0, upper 1, digits 2, white space 3, full stops and commas 4, other ASCII 5, non-ASCII 0."""
    kind = np.full(256, 5)
    kind[[*range(97, 123), *range(128, 256)]] = 0
    kind[65:91], kind[48:58] = 1, 2
    kind[[9, 10, 11, 12, 13, 32]] = 3
    kind[[44, 46]] = 4
    return kind


_KIND = _kinds()


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; counts by log(1 + x), shares by log(x + 0.01)."""
    data = (text or "").encode()
    n = max(1, len(data))
    lower, upper, digits, _, stops, other = (np.bincount(_KIND, np.bincount(np.frombuffer(data, np.uint8), minlength=256), 6)).tolist()
    words, lines = data.split(), data.splitlines()
    w = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    share = lambda x: float(np.log(x + 0.01))
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), float(np.log1p(lengths.sum() / w)),
        share((lower + upper) / n), share(upper / n), share(digits / n), share(stops / n), share(other / n),
        share(len(counts) / w), share(max(counts.values(), default=0) / w), float(np.log1p(len(lines))), float(np.log1p(len(data) / max(1, len(lines)))),
        share(1 - len(set(lines)) / max(1, len(lines))), share(float((lengths > 12).sum()) / w),
        share(sum(map(bytes.isupper, words)) / w), share(sum(not x[-1:].isalnum() and x[-1] < 128 for x in words) / w),
    ]


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, f0, f1, ...): the statistics of each row's text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = np.array([statistics(t) for t in part.column(1).to_pylist()]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in rows.T)], names=["k", *FEATURES])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, " + ", ".join(f"{f} double" for f in FEATURES))
    return out.withColumnRenamed("k", key)


class Discriminant:
    """Class priors, means and inverse Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        """moments: class -> (rows, mean, covariance)."""
        total = sum(m[0] for m in moments.values())
        self.share = moments[1][0] / total if 1 in moments else 0.0 if total else 0.5
        self.classes: list[tuple] = []
        if len(moments) < 2:
            return
        pooled = sum(n * c for n, _, c in moments.values()) / total
        for k in (0, 1):
            n, mean, own = moments[k]
            own = (1 - TO_POOLED) * own + TO_POOLED * pooled
            own = (1 - TO_DIAGONAL) * own + TO_DIAGONAL * np.diag(np.diag(own)) + FLOOR * np.eye(len(mean))
            factor = np.linalg.cholesky(own)
            self.classes.append((np.log(n / total) - np.log(np.diag(factor)).sum(), mean, np.linalg.inv(factor).T))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """P(class 1); the share of class 1 where only one class or none was seen."""
        if not self.classes:
            return np.full(len(rows), self.share)
        zero, one = (base - 0.5 * (((rows - mean) @ white) ** 2).sum(axis=1) for base, mean, white in self.classes)
        return 1 / (1 + np.exp(np.clip(zero - one, -500, 500)))


def fit(rows: DataFrame, label: str = "quality") -> Discriminant:
    """From all rows of (FEATURES, `label` 0 or 1); other labels are passed over.

    Spark sums; one row for each class comes to the driver.
    """
    d = len(FEATURES)
    seen = rows.where(F.col(label).isin(0, 1))
    first = seen.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in FEATURES]).collect()
    means = {int(r[label]): (r.n, np.array([r[f] for f in FEATURES])) for r in first}
    if not means:
        return Discriminant({})
    centre = sum(m for _, m in means.values()) / len(means)  # sums about it keep their digits
    about = seen.select(label, *[(F.col(f) - float(c)).alias(f) for f, c in zip(FEATURES, centre, strict=True)])
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    second = about.groupBy(label).agg(*[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    moments = {}
    for r in second:
        n, mean = means[int(r[label])]
        square = np.zeros((d, d))
        for i, j in pairs:
            square[i, j] = square[j, i] = r[f"s{i}_{j}"]
        away = mean - centre
        moments[int(r[label])] = (n, mean, square / n - np.outer(away, away))
    return Discriminant(moments)


def score(rows: DataFrame, model: Discriminant, key: str = "doc_id") -> DataFrame:
    """(`key`, score): 0 to 1, higher for class 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "score": model.score(batch[list(FEATURES)].to_numpy())})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), *FEATURES).mapInPandas(run, f"k {kind}, score double").withColumnRenamed("k", key)


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(measured(table(spark, sf_dir, "documents")))
    held_out = fold_of(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    out = score(rows, fit(rows.join(labels, "doc_id")))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
