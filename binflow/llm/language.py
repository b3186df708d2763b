"""Language identification by rank-order profiles of letter n-grams.

A profile lists the most frequent 1- to 3-grams of a language's words, with word borders, in
falling order. A document gets the language whose profile its own list is least out of place
with: the sum, over its n-grams, of the distance between both ranks, an n-gram that the
profile lacks counting as the length of a profile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binflow.llm.common import fold_of, query, table, working

#: N-grams in a profile, of a language and of a document.
LENGTH = 300
BORDER = 1
BLOCK = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(text: str | None) -> np.ndarray:
    """The letters of a text in lower case, with one border around and between its words."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.where(letter, points, BORDER)[keep]
    return np.concatenate([[BORDER], out, [BORDER] * int(letter[-1])]).astype(np.uint64)


def grams(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams within words; 21 bits a symbol.

    Long texts are counted in blocks, so that memory follows the number of distinct n-grams.
    """
    known, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for at in range(0, max(0, len(seq) - 1), BLOCK):
        s = seq[at : at + BLOCK + 2]
        own = s[:BLOCK]  # each n-gram belongs to the block in which it begins
        two = s[: len(own)][: len(s) - 1] | s[1:][: len(own)] << np.uint64(21)
        m = min(len(own), len(s) - 2)
        three = two[:m] | s[2 : 2 + m] << np.uint64(42)
        inner = (own[: len(two)] != BORDER) | (s[1:][: len(two)] != BORDER)
        codes = np.concatenate([own[own != BORDER], two[inner], three[s[1 : 1 + m] != BORDER]])
        k, c = np.unique(codes, return_counts=True)
        known, counts = _merged(known, counts, k, c)
    return known, counts


def _merged(k1, c1, k2, c2):
    if not len(k1):
        return k2, c2
    keys, at = np.unique(np.concatenate([k1, k2]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c1, c2]), len(keys)).astype(np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", length: int = LENGTH) -> DataFrame:
    """(lang, gram long, rank int): the profiles, learnt from all rows with a language.

    Tasks count n-grams before anything is shuffled. Of equal counts the lower code leads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        working("language")
        counts: dict[str, tuple] = {}

        def rows():
            for name, (k, c) in counts.items():
                for at in range(0, len(k), 100_000):
                    yield pd.DataFrame({"lang": name, "gram": k[at : at + 100_000].view(np.int64), "n": c[at : at + 100_000]})
            counts.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own: dict[str, list] = {}
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own.setdefault(name, []).append(symbols(t))
                for name, seqs in own.items():
                    counts[name] = _merged(*counts.get(name, (np.empty(0, np.uint64), np.empty(0, np.int64))), *grams(np.concatenate(seqs)))
            if sum(len(k) for k, _ in counts.values()) > 2_000_000:
                yield from map(pa.RecordBatch.from_pandas, rows())
        yield from map(pa.RecordBatch.from_pandas, rows())

    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("t"))
    summed = known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    return ranked.where(F.col("rank") <= length).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class Profiles:
    """Profiles as one table of ranks: a row for each language, a column for each n-gram."""

    def __init__(self, rows: list[tuple[str, int, int]], length: int = LENGTH):
        self.langs = sorted({r[0] for r in rows})
        self.length = length
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64).view(np.uint64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        at = {name: i for i, name in enumerate(self.langs)}
        for name, gram, rank in rows:
            self.ranks[at[name], np.searchsorted(self.codes, np.uint64(gram % 2**64))] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and 1 - distance / largest possible distance; of equal distances the
        first name. `und` and 0 without a letter or a profile."""
        seq = symbols(text)
        if not len(seq) or not self.langs:
            return UNKNOWN, 0.0
        known, counts = grams(seq)
        top = np.lexsort((known.view(np.int64), -counts))[: self.length]
        known = known[top]
        at = np.searchsorted(self.codes, known)
        at = np.where((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == known), at, len(self.codes))
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.length * len(top)))


def predict(docs: DataFrame, profiles: DataFrame, text: str = "text", keep: list[str] | None = None, length: int = LENGTH) -> DataFrame:
    """The columns `keep` of `docs` (all, if not given) with lang_pred and score; columns of
    those names give way.

    The profiles, `length` rows for each language, reach the tasks by way of the driver.
    """
    model = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in profiles.select("lang", "gram", "rank").collect()])
    held: dict = {}
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    place = names.index(text) if text in names else len(names)
    count = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("language")
        p = held.get("p") or held.setdefault("p", Profiles(model.value, length))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [p.predict(t) for t in part.column(place).to_pylist()]
                columns = [*part.columns[:count], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*list(part.schema)[:count], ("lang_pred", pa.string()), ("score", pa.float64())]))

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    read = docs.select(*names, *([] if text in names else [F.col(text).alias("_text")]))
    return read.mapInArrow(run, f"{fields}lang_pred string, score double")


#: Below this score a text fits none of the profiles.
LEAST_SCORE = 0.2


def recognised(docs: DataFrame, profiles: DataFrame, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs` in one of the learnt languages, with their columns: those without a
    letter, and those that fit no profile, go."""
    found = predict(docs, profiles, text).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*docs.columns)


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    profiles = train(docs.where(~F.coalesce(held_out, F.lit(False))))
    found = predict(docs, profiles, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
