"""Benchmark decontamination by spaced seeds.

A seed is a window of tokens of which a fixed mask leaves some out; equal hashes of the
tokens left mark a candidate however the tokens left out differ. Benchmark seeds are joined
with the seeds of every document inside the tasks that read the documents, so neither texts
nor seeds of documents are shuffled. Around each hit both token sequences are laid on each
other without gaps, and the longest stretch with the agreement asked for decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow import session
from binflow.llm.common import KEPT, query, stored, table, working

#: Positions that count, in windows of eight tokens.
MASKS = ((0, 1, 3, 5, 7), (0, 2, 3, 6, 7), (0, 1, 2, 5, 7), (0, 3, 4, 5, 7))
SPAN = 8
#: Positions for items of few tokens: every overlap that is a leak of such an item has one of these windows whole.
SHORT_MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 1, 3, 6, 7))
SHORT_ITEM = 12
#: An overlap is a leak from so many tokens on, or from this share of its item on ...
LEAST_TOKENS, LEAST_SHARE = 13, 0.8
#: ... if at least this share of its tokens are equal.
AGREEMENT = 0.8
#: Items with fewer tokens are no evidence of a leak. Those that a window doesn't fit into leak
#: when they occur whole and unchanged.
SHORTEST_ITEM = 5
#: Benchmark text that is held in a task at once, its index takes about 25 times that; more is worked off block by block.
BLOCK_BYTES = 8 << 20
PIECE = 1 << 20


@cache
def _constants():
    rng = np.random.default_rng(11)
    letters = rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    word = np.zeros(256, bool)
    word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    base = int(rng.integers(1 << 40, 1 << 62)) | 1
    weights = rng.integers(0, 2**63, SPAN, np.uint64) * np.uint64(2) + np.uint64(1)
    return letters, word, base, pow(base, -1, 1 << 64), weights


_powers: dict[int, np.ndarray] = {}
KEPT["decontaminate"] = _powers.clear


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 4096), np.uint64(base))
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def token_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each token: a run of letters, digits and non-ASCII characters, in
    lower case. Long texts are taken in pieces that end between tokens."""
    letters, word, base, inverse, _ = _constants()
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and word[data[end]]:
            end += 1
        part = data[at:end]
        edge = np.diff(np.concatenate([[0], word[part].view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[part] * _power(base, len(part)), dtype=np.uint64)])
        out.append((sums[ends] - sums[starts]) * _power(inverse, len(part) + 1)[starts])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def seeds(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of each window under a mask; none if there are fewer tokens than it spans."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    weights = _constants()[4]
    h = np.zeros(n, np.uint64)
    for k, p in enumerate(mask):
        h += tokens[p : p + n] * weights[k]
    return h ^ h >> np.uint64(29)


def longest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The longest [start, end) that begins and ends with an equal token and has AGREEMENT; the
    first of equally long ones, (0, 0) without equal tokens."""
    places = np.flatnonzero(equal)
    if not len(places):
        return 0, 0
    # A stretch has the agreement if the sum at its end is no lower than that at its start.
    score = np.concatenate([[0.0], np.cumsum(equal - AGREEMENT)])
    ends = places + 1
    first = np.searchsorted(-np.minimum.accumulate(score), -(score[ends] + 1e-9))
    # Places passed over only lower the sum, so the next equal token starts a stretch as well.
    starts = places[np.searchsorted(places, first)]
    best = int(np.argmax(ends - starts))
    return int(starts[best]), int(ends[best])


class Index:
    """Seeds of benchmark items: one sorted table for each mask. Items of up to SHORT_ITEM tokens
    have their masks, items shorter than a window one of their own length."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.tokens = [], []
        for item, text in items:
            tokens = token_hashes(text)
            if len(tokens) >= SHORTEST_ITEM:
                self.ids.append(item)
                self.tokens.append(tokens)
        whole = sorted({len(t) for t in self.tokens if len(t) < SPAN})
        masks = [(m, SHORT_ITEM + 1, math.inf) for m in MASKS] + [(m, SPAN, SHORT_ITEM) for m in SHORT_MASKS] + [(tuple(range(n)), n, n) for n in whole]
        self.tables = []
        for mask, least, most in masks:
            own = [i for i, t in enumerate(self.tokens) if least <= len(t) <= most]
            hashes = [seeds(self.tokens[i], mask) for i in own]
            flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
            item = np.repeat(np.array(own, np.int32), [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes]) if hashes else np.empty(0, np.int32)
            order = np.argsort(flat, kind="stable")
            bits = max(16, int(len(flat)).bit_length() + 2)
            seen = np.zeros(1 << bits, bool)
            seen[flat >> np.uint64(64 - bits)] = True
            self.tables.append((mask, flat[order], item[order], place[order], bits, seen))

    def diagonals(self, tokens: np.ndarray) -> np.ndarray:
        """Distinct (item, offset of the item's first token in the text) of all hits."""
        found = []
        for mask, flat, item, place, bits, seen in self.tables:
            if not len(flat):
                continue
            h = seeds(tokens, mask)
            at = np.flatnonzero(seen[h >> np.uint64(64 - bits)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(flat, h[at], "left"), np.searchsorted(flat, h[at], "right")
            n = hi - lo
            if n.any():
                k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.stack([item[k], np.repeat(at, n) - place[k]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def overlaps(self, text: str | None) -> list[tuple]:
        """(item id, start token in the text, length, equal tokens, share of the item) of the
        best leak of each item."""
        tokens = token_hashes(text)
        best: dict[int, tuple] = {}
        for item, shift in self.diagonals(tokens).tolist():
            own = self.tokens[item]
            lo, hi = max(0, -shift), min(len(own), len(tokens) - shift)
            equal = own[lo:hi] == tokens[lo + shift : hi + shift]
            start, end = longest_stretch(equal)
            length, same = end - start, int(equal[start:end].sum())
            if len(own) < SPAN:
                leaked = same == len(own)
            else:
                leaked = length >= LEAST_TOKENS or length >= LEAST_SHARE * len(own)
            if length and leaked:
                row = (self.ids[item], shift + lo + start, length, same, length / len(own))
                if item not in best or (row[3], -row[1]) > (best[item][3], -best[item][1]):
                    best[item] = row
        return sorted(best.values())


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(h, i, t): the items with a text; h tells texts apart, so equal ones are searched once."""
    return benchmark.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(key).alias("i"), F.col(text).cast("string").alias("t"))


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[Index]:
    """Indexes over all different texts of the items, `block_bytes` of text in each."""
    texts = items.groupBy("h").agg(F.min("t").alias("t"))
    total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        rows = texts.where(F.pmod(F.col("h"), F.lit(n)) == k).collect()
        yield Index(sorted((r.h, r.t) for r in rows))


FOUND = "h long, start long, overlap long, equal long, share double"


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(`key`, item_id, start, overlap, equal, share): each document and item that overlap.

    The documents are read once for each block of the benchmark. Null and empty texts leak
    nothing; repeated rows are reported repeatedly. Items with equal texts are each reported,
    an item without an id under a null one, the same id and text once.
    """
    kind = docs.schema[key].dataType.simpleString()
    items, parts = stored(_items(benchmark, item, "text")), []
    context = docs.sparkSession.sparkContext
    for index in _blocks(items, block_bytes):
        held = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            working("decontaminate")
            for batch in batches:
                where, rows = [], []
                for i in range(batch.num_rows):
                    found = held.value.overlaps(batch.column(1)[i].as_py())
                    where += [i] * len(found)
                    rows += found
                columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["k", "h", "start", "overlap", "equal", "share"],
                )

        parts.append(stored(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, {FOUND}")))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"{key} {kind}, item_id long, start long, overlap long, equal long, share double")
    names = session.small(items.select("h", F.col("i").alias("item_id")).distinct())
    return reduce(DataFrame.unionByName, parts).join(names, "h").select(F.col("k").alias(key), "item_id", "start", "overlap", "equal", "share")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` whose text overlaps no item, with all their columns.

    Rows that are left are written out between the blocks of the benchmark, so a task holds one
    block. Null and empty texts stay, repeated rows stay or go together; an item counts
    whatever its id. Without items nothing goes.
    """
    context = docs.sparkSession.sparkContext
    for n, index in enumerate(_blocks(_items(benchmark, item, "text"), block_bytes)):
        held, place = context.broadcast(index), docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], held=held, place=place) -> Iterator[pa.RecordBatch]:
            working("decontaminate")
            for batch in batches:
                keep = [not held.value.overlaps(t.as_py()) for t in batch.column(place)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = (stored(docs) if n else docs).mapInArrow(run, docs.schema)
    return docs


@query("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
