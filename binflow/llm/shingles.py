"""Near duplicates: SimHash fingerprints, completed to the exact Jaccard similarity of word-shingle sets.

The walk of `simhash` over the trie of the sets' fingerprints finds the near copies that lie within
its budget; each is verified on the sets. What it leaves apart is then searched exactly, and members
that only sets of one component share lead to nothing any more.

Two sets at least `threshold` alike share one of their first members, in any order that all
sets use: of n members, all but threshold * n - 1. Sets that share a first member are
candidates, and each link is verified on the whole sets. A member that is in one set but not in
the other changes one bit of a parity vector, so vectors that differ in more bits than so many
members may differ rule a pair out before its sets are made.

Members that a sample of the texts shows to be common come last in the first order; the sample
only saves work. Every set is compared with the most ordinary one of each bucket, and sets that
are still in different components are paired. Buckets that are then too crowded to be paired
hold members that are common without the sample knowing. The sets in them are ordered again, by
the number of such sets that have each member, and only what is rare among them leads to
pairs, limited by sizes and places. The sample grows with the texts: a fixed one would know
less and less of what is common, and leave ever more sets to be ordered again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow import session
from binflow.llm import simhash
from binflow.llm.common import release, stored, working
from binflow.llm.graph import components
from binflow.llm.simhash import fingerprint, keep_first, shingle_hashes

SIZE, THRESHOLD = 5, 0.8
#: Bits in which linked fingerprints may differ; more find more links before the exact search.
BUDGET = 3
#: Sets in the sample for common members, out of so many, and the most members that it names.
SAMPLE, OF, COMMON = 4_000, 50_000, 4_000_000
#: Sets that are ordered again are counted as a whole up to this share of all members, and
#: by a sample of that share beyond.
COUNTED = 0.25
#: Sets of a bucket that are paired without an exact order.
CROWD = 32
#: Shingle members that a batch of results holds.
SLICE = 1 << 17


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray]]:
    """Keys, distinct shingle hashes in ascending order, and a hash of them all: some rows at a time."""
    from xxhash import xxh64_intdigest

    working("shingles")
    for batch in batches:
        start, sets, held = 0, [], 0
        for i, t in enumerate(batch.column(1)):
            sets.append(np.unique(shingle_hashes(t.as_py(), size)))
            held += len(sets[-1]) + 64
            if held >= SLICE or i == batch.num_rows - 1:
                fps = np.array([xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
                yield batch.column(0)[start : i + 1], sets, fps
                start, sets, held = i + 1, [], 0


def shingle_sets(docs: DataFrame, key: str, text: str, size: int = SIZE) -> DataFrame:
    """(`key`, fp, s): each text's distinct shingle hashes, ascending, and a hash of them all.

    A text without words, null or empty, has no members. Every row of `docs` gives one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets, fps in _sets(batches, size):
            yield pa.RecordBatch.from_arrays([keys, pa.array(fps), _lists([s.view(np.int64) for s in sets])], names=["k", "fp", "s"])

    kind = docs.schema[key].dataType.simpleString()
    return _texts(docs, key, text).mapInArrow(run, f"k {kind}, fp bigint, s array<bigint>").withColumnRenamed("k", key)


def parities(own: np.ndarray) -> bytes:
    """Of each rest of the members modulo a power of two, at least their number, whether an odd
    number of them has it."""
    m = max(64, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """At least how many members are in one of two sets only, from their parities."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x))) ^ x).sum())


def described(docs: DataFrame, key: str, text: str, size: int = SIZE) -> DataFrame:
    """(`key`, fp, n, sim, parity): of each text's set its hash, its size, its SimHash fingerprint
    and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets, fps in _sets(batches, size):
            sims = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            columns = [keys, pa.array(fps), pa.array([len(s) for s in sets], pa.int32()), pa.array(sims), pa.array([parities(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "fp", "n", "sim", "parity"])

    kind = docs.schema[key].dataType.simpleString()
    return _texts(docs, key, text).mapInArrow(run, f"k {kind}, fp bigint, n int, sim bigint, parity binary").withColumnRenamed("k", key)


def first_of(n: int, threshold: float) -> int:
    """How many first members of n decide."""
    return n - math.ceil(n * threshold - 1e-9) + 1 if n else 0


def common_members(docs: DataFrame, key: str, text: str, size: int, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least `least` sets of the texts, ascending, and in how many of them they are.
    Of more than COMMON those with the greatest counts; the driver holds no others."""
    every = shingle_sets(docs, key, text, size).select(F.explode("s").alias("m"))
    found = stored(every.groupBy("m").agg(F.count("*").cast("int").alias("c")).where(F.col("c") >= least))
    release(docs.sparkSession)
    held, cut = 0, 0
    for r in found.groupBy(F.least("c", F.lit(10_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        held += r["n"]
        if held > COMMON:
            cut = r["c"] + 1
            break
    rows = found.where(F.col("c") >= cut).select("m", "c").toArrow()
    m, c = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(m)
    return m[order], c[order]


def first_members(docs: DataFrame, key: str, text: str, size: int, threshold: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(m, fp, w): the first members of each text's set, its hash, and in one number of how many
    members the sample knows nothing (from bit 32) and the member's place, from 1. Texts with
    equal sets may repeat rows."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = held.value
        sent: set[int] = set()
        for _, sets, fps in _sets(batches, size):
            rows: list[np.ndarray] = []
            for own, fp in zip(sets, fps.tolist(), strict=True):
                if fp in sent or not len(own):
                    continue
                if len(sent) >= SLICE:
                    sent.clear()
                sent.add(fp)
                count = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    count = np.where(known[at] == own, counts[at], 0)
                first = own[np.lexsort((own, count))[: first_of(len(own), threshold)]].view(np.int64)
                odd = int((count == 0).sum()) << 32
                rows.append(np.stack([first, np.full(len(first), fp), odd + np.arange(1, len(first) + 1)]))
            m, fp, w = np.concatenate(rows, axis=1) if rows else np.empty((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(fp), pa.array(w)], names=["m", "fp", "w"])

    return _texts(docs, key, text).mapInArrow(run, "m bigint, fp bigint, w bigint")


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least `threshold` alike. sets_of: the whole sets (fp, s)
    of a table of fp, each once; only sets that are in a pair are made."""
    pairs = stored(pairs)
    ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    sets = sets_of(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = p.values.to_numpy(), q.values.to_numpy()
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                near[i] = both >= threshold * (len(x) + len(y) - both) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(near))

    left, right = (sets.select(F.col("fp").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    found = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint"))
    release(pairs.sparkSession)
    return found


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class Join:
    """Links between sets, grown round by round: components take the place of all their pairs."""

    def __init__(self, sets_of: Callable[[DataFrame], DataFrame], threshold: float, groups: DataFrame):
        self.sets_of, self.threshold, self.groups = sets_of, threshold, groups
        self.links: DataFrame | None = None

    def check(self, pairs: DataFrame) -> None:
        found = verified(self.possible(pairs.distinct()), self.sets_of, self.threshold)
        self.links = found if self.links is None else self.links.unionByName(found)

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and parities do not rule out."""
        threshold = self.threshold
        for x in "ab":
            pairs = pairs.join(self.groups.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")), x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                apart = [least_apart(p.as_py(), q.as_py()) for p, q in zip(batch.column("pa"), batch.column("pb"), strict=True)]
                both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
                near = np.array(apart, np.int64) * (1 + threshold) <= both * (1 - threshold) + 1e-6
                yield batch.select(["a", "b"]).filter(pa.array(near))

        return pairs.mapInArrow(run, "a bigint, b bigint")

    def walked(self, budget: int) -> None:
        """Compare sets whose SimHash fingerprints the walk of their trie links, or that share one."""
        signed = self.groups.groupBy("sim").agg(F.min("fp").alias("first"))
        signed = stored(signed)
        same = self.groups.join(signed, "sim").where("fp != first").select(*_pair(F.col("fp"), F.col("first")))
        near = simhash.links(signed.select(F.col("sim").alias("fp")), budget)
        for x in "ab":
            near = near.join(signed.select(F.col("sim").alias(x), F.col("first").alias(f"f{x}")), x)
        self.check(same.unionByName(near.select(*_pair(F.col("fa"), F.col("fb")))))

    def may_be_alike(self, n: Column, at: Column, m: Column, to: Column) -> Column:
        """Whether sets of n and m members can be alike that share their members at places `at` and
        `to`, from 1, and none before: no more than what follows in both."""
        sizes = F.least(n, m) >= F.greatest(n, m) * self.threshold - 1e-9
        return sizes & ((F.least(n - at, m - to) + 1) * (1 + self.threshold) >= (n + m) * self.threshold - 1e-6)

    def stars(self, both: DataFrame) -> None:
        """Compare every set with its bucket's centre. both: (m, fp, n, at, c: struct with fp, n, at)."""
        near = both.where((F.col("fp") != F.col("c.fp")) & self.may_be_alike(F.col("n"), F.col("at"), F.col("c.n"), F.col("c.at")))
        self.check(near.select(*_pair(F.col("fp"), F.col("c.fp"))))

    def open(self, both: DataFrame) -> DataFrame:
        """The rows of buckets that still hold several components, with their root r and the
        bucket's size."""
        roots = stored(components(self.links))
        named = both.join(roots, both["fp"] == roots["node"], "left").withColumn("r", F.coalesce("root", "fp")).drop("node", "root")
        split = named.groupBy("m").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.count("*").alias("rows")).where("r0 != r1").select("m", "rows")
        return stored(named.join(split, "m"))

    def pairs(self, left: DataFrame) -> None:
        """Compare the sets of different components of each bucket: (m, fp, n, at, r). Sets that
        are alike pass in the bucket of the first member that they share."""
        one = left.select("m", F.col("fp").alias("a"), "n", "r", "at")
        two = left.select("m", F.col("fp").alias("b"), F.col("n").alias("n2"), F.col("r").alias("r2"), F.col("at").alias("at2"))
        near = one.join(two, "m").where((F.col("r") < F.col("r2")) & self.may_be_alike(F.col("n"), F.col("at"), F.col("n2"), F.col("at2")))
        self.check(near.select(*_pair(F.col("a"), F.col("b"))))


def shared_members(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(m, fp, n, odd, at): the rows of `found` (m, fp, w), as of `first_members`, whose member
    several sets have, each once."""
    # Most members are in one set only. Each row is shuffled once, with nothing but the two hashes
    # and one number; rows of equal sets follow one another.
    of_member = Window.partitionBy("m").orderBy("fp")
    whole = of_member.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = found.select("m", "fp", "w", F.lag("fp").over(of_member).alias("up"), F.min("fp").over(whole).alias("lo"), F.max("fp").over(whole).alias("hi"))
    shared = stored(shared.where("lo != hi AND (up IS NULL OR up != fp)").select("m", "fp", "w"))
    release(found.sparkSession)
    placed = shared.select("m", "fp", F.shiftright("w", 32).cast("int").alias("odd"), F.col("w").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("at"))
    return placed.join(groups.select("fp", "n"), "fp")


def set_components(groups: DataFrame, firsts: Callable[[DataFrame | None], DataFrame], sets_of: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD, crowd: int = CROWD, budget: int = BUDGET) -> DataFrame:
    """(node, root): the least fp that links of each set reach, for sets with links.

    groups: (fp, n, sim, parity), one row for each set; firsts: the first members (m, fp, w) of
    all sets, w as in `first_members`, or those of a table (fp, n) in an order of its own;
    sets_of: the whole sets (fp, s) of a table of fp.
    """
    join = Join(sets_of, threshold, groups)
    join.walked(budget)

    def compared(found: DataFrame) -> DataFrame:
        """What stays open after every set was compared with the centre of its buckets."""
        both = join.open(shared_members(found, groups)).drop("r", "rows")
        join.stars(both.join(both.groupBy("m").agg(F.min(F.struct("odd", "fp", "n", "at")).alias("c")), "m"))
        return join.open(both)

    left = compared(firsts(None))
    join.pairs(left.where(F.col("rows") <= crowd))
    crowded = stored(left.where(F.col("rows") > crowd).select("fp", "n").distinct())
    if crowded.limit(1).count():
        join.pairs(compared(firsts(crowded)))
    return components(join.links)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, crowd: int = CROWD, budget: int = BUDGET) -> DataFrame:
    """One row of `docs` for each component, that with the least id, as in `simhash.deduplicated`.

    Texts are linked whose shingle sets have Jaccard similarity `threshold` or more; those
    without words are alike.
    """
    known = stored(described(docs, key, text, size))
    groups = stored(known.groupBy("fp").agg(F.min(key).alias("least"), *[F.first(c).alias(c) for c in ("n", "sim", "parity")]))

    def rows_of(wanted: DataFrame) -> DataFrame:
        # A text (k, t) of each set (fp, least), found by the least id that has it; other texts may
        # have that id, and rows that repeat an id and a text give a set again.
        ids = session.small(stored(wanted.select(F.col("least").alias("id")).distinct()))
        rows = _texts(docs, key, text)
        return rows.join(ids, rows["k"].eqNullSafe(ids["id"]), "left_semi")

    def sets_of(fps: DataFrame) -> DataFrame:
        wanted = stored(groups.join(fps, "fp", "left_semi").select("fp", "least"))
        made = shingle_sets(rows_of(wanted), "k", "t", size).join(session.small(wanted.select("fp")), "fp", "left_semi")
        return made.groupBy("fp").agg(F.first("s").alias("s"))

    def sampled(wanted: DataFrame, every: int) -> DataFrame:
        return rows_of(wanted.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0))

    def firsts(crowded: DataFrame | None) -> DataFrame:
        whole = groups.agg(F.count("*").alias("sets"), F.sum("n").alias("members")).first()
        if crowded is None:
            every = max(1, whole["sets"] // int(SAMPLE * max(1, whole["sets"] / OF)))
            return first_members(docs, key, text, size, threshold, common_members(sampled(groups, every), "k", "t", size))
        wanted = stored(groups.join(crowded.select("fp"), "fp", "left_semi").select("fp", "least"))
        members = crowded.agg(F.sum("n").alias("members")).first()["members"]
        every = max(1, math.ceil(members / (COUNTED * whole["members"])))
        common = common_members(sampled(wanted, every), "k", "t", size, 2 if every == 1 else 3)
        return first_members(rows_of(wanted), "k", "t", size, threshold, common)

    roots = set_components(groups, firsts, sets_of, threshold, crowd, budget)
    named = groups.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    class_of = stored(named.join(least, "root").select("fp", "root", "component"))
    return keep_first(docs, key, text, known.select(key, "fp"), class_of, lambda rows: shingle_sets(rows, "_t", "_t", size).select("_t", "fp"))
