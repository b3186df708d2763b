"""SimHash near duplicates: 64-bit fingerprints, linked by a self-join of their binary trie.

The join walks pairs of trie nodes from the root down, four bits a step. A pair carries the
number of bits in which its two prefixes differ and is pruned when they exceed the budget.
While a node still holds many fingerprints the step is a Spark join of node pairs with the
children of their nodes; pairs of small nodes go to tasks, which walk the rest of both
subtrees in numpy. A task returns a spanning forest of the links that it finds, not all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binflow.llm.common import query, stored, table
from binflow.llm.graph import components

BITS = 64
STEP = 4
#: Fingerprints of a node that a task takes; larger nodes are split into their children first.
NODE = 40_000


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle; fewer words make one shingle, none make none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and \x20 \x09-\x0D only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    runs = zip(*(words[i:] for i in range(size)), strict=False)
    return np.fromiter((xxh64_intdigest(b" ".join(r), 42) for r in runs), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """A bit is 1 if more than half the hashes have it; 0 without hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        part = np.unpackbits(hashes[at : at + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(`key`, fp long): the fingerprint of each whole text, as a signed 64-bit number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t, size)) for t in batch["t"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"k": batch["k"], "fp": fps})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInPandas(run, f"k {kind}, fp bigint")
    return out.withColumnRenamed("k", key)


def _children(lo: np.ndarray, hi: np.ndarray, fps: np.ndarray, bit: int) -> np.ndarray:
    """Where the fingerprints with `bit` set begin within each sorted run [lo, hi)."""
    at = fps[lo] >> np.uint64(bit + 1) << np.uint64(1) | np.uint64(1)
    return np.clip(np.searchsorted(fps, at << np.uint64(bit)), lo, hi)


def walk(a: np.ndarray, b: np.ndarray, budget: int, top: int = BITS, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with a[i] and b[j] at most `budget` bits apart, in blocks.

    a, b: sorted; the fingerprints of each agree in all bits from `top` up. Node pairs are
    runs of a and b, a stack of chunks keeps few of them in memory.
    """
    if not len(a) or not len(b):
        return
    one = lambda x: np.array([x], np.int64)
    least = ((int(a[0]) ^ int(b[0])) >> top).bit_count()
    stack = [(top, one(0), one(len(a)), one(0), one(len(b)), one(least))]
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        # Small pairs are compared as they stand.
        sizes = (ahi - alo) * (bhi - blo)
        leaf = (sizes <= 16) | (bit == 0)
        if leaf.any():
            n, l, m, w = sizes[leaf], alo[leaf], blo[leaf], (bhi - blo)[leaf]
            rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = np.repeat(w, n)
            i, j = np.repeat(l, n) + rank // w, np.repeat(m, n) + rank % w
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            yield i[near], j[near]
        if leaf.all():
            continue
        alo, ahi, blo, bhi, diff = (x[~leaf] for x in (alo, ahi, blo, bhi, diff))
        bit -= 1
        am, bm = _children(alo, ahi, a, bit), _children(blo, bhi, b, bit)
        parts = [(alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1), (am, ahi, blo, bm, diff + 1)]
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= budget)
        joined = [x[keep] for x in joined]
        for at in range(0, len(joined[0]), chunk):
            stack.append((bit, *(x[at : at + chunk] for x in joined)))


class Forest:
    """Union by least root over the nodes 0..n-1; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links in one block; those within a tree are passed over together."""
        while len(i):
            while not np.array_equal(flat := self.up[self.up], self.up):
                self.up = flat
            apart = self.up[i] != self.up[j]
            i, j = i[apart], j[apart]
            for x, y in zip(i[:256].tolist(), j[:256].tolist(), strict=True):
                p, q = self.root(x), self.root(y)
                if p != q:
                    self.up[max(p, q)] = min(p, q)
                    self.links.append((x, y))
            i, j = i[256:], j[256:]


def node_links(a: np.ndarray, b: np.ndarray, same: bool, budget: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two node's fingerprints."""
    forest = Forest(len(a) if same else len(a) + len(b))
    for i, j in walk(a, b, budget, top):
        if same:
            i, j = i[i < j], j[i < j]
            forest.add(i, j)
        else:
            forest.add(i, j + len(a))
    every = a if same else np.concatenate([a, b])
    pairs = np.array(forest.links, np.int64).reshape(-1, 2)
    return every[pairs[:, 0]], every[pairs[:, 1]]


def links(fps: DataFrame, budget: int = 3, node: int = NODE) -> DataFrame:
    """(a, b): links between distinct fingerprints at most `budget` bits apart, enough of them
    to connect whatever all of them connect.

    fps: one column fp long, distinct. A group of mutually near fingerprints yields a forest.
    """
    spark = fps.sparkSession
    top = lambda depth: F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    whole = fps.count()
    counts = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(whole).cast("long").alias("rows"))
    pairs = stored(counts.select(F.col("n").alias("x"), F.col("n").alias("y"), F.lit(0).alias("diff"), F.col("rows").alias("nx"), F.col("rows").alias("ny")))
    depth, done = 0, []
    while whole > node and depth < BITS:
        depth += STEP
        nodes = stored(fps.groupBy(top(depth).alias("n")).agg(F.count("*").alias("rows")))
        child = nodes.withColumn("up", F.shiftrightunsigned("n", STEP))
        left = child.select(F.col("up").alias("x"), F.col("n").alias("cx"), F.col("rows").alias("mx"))
        right = child.select(F.col("up").alias("y"), F.col("n").alias("cy"), F.col("rows").alias("my"))
        open_ = pairs.where(F.greatest("nx", "ny") > node)
        done.append(pairs.where(F.greatest("nx", "ny") <= node).withColumn("depth", F.lit(depth - STEP)))
        low = F.col("cx").bitwiseXOR(F.col("cy")).bitwiseAND((1 << STEP) - 1)
        grown = open_.join(left, "x").join(right, "y").withColumn("diff", (F.col("diff") + F.bit_count(low)).cast("int"))
        grown = grown.where((F.col("diff") <= budget) & ((F.col("x") != F.col("y")) | (F.col("cx") <= F.col("cy"))))
        pairs = stored(grown.select(F.col("cx").alias("x"), F.col("cy").alias("y"), "diff", F.col("mx").alias("nx"), F.col("my").alias("ny")))
        if not pairs.where(F.greatest("nx", "ny") > node).limit(1).count():
            break
    done.append(pairs.withColumn("depth", F.lit(depth)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        depth, x, y = map(int, key)
        a = np.sort(rows["fp"].to_numpy()[rows["side"].to_numpy() == 0].view(np.uint64))
        b = a if x == y else np.sort(rows["fp"].to_numpy()[rows["side"].to_numpy() == 1].view(np.uint64))
        i, j = node_links(a, b, x == y, budget, BITS - depth)
        return pd.DataFrame({"a": i.view(np.int64), "b": j.view(np.int64)})

    found = None
    for ready in done:
        depth = ready.select("depth").first()
        if depth is None:
            continue
        at = fps.withColumn("n", top(depth.depth))
        one = ready.select("depth", "x", "y", F.col("x").alias("n"), F.lit(0).alias("side"))
        two = ready.where("x != y").select("depth", "x", "y", F.col("y").alias("n"), F.lit(1).alias("side"))
        sent = at.join(one.unionByName(two), "n").select("depth", "x", "y", "side", "fp")
        part = sent.groupBy("depth", "x", "y").applyInPandas(run, "a bigint, b bigint")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)


def _classes(known: DataFrame, key: str, budget: int, node: int) -> DataFrame:
    """(fp, root, component): the group that each fingerprint's links reach, by its least
    fingerprint, and the least id among its documents."""
    groups = stored(known.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(groups.select("fp"), budget, node))
    named = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return stored(named.join(least, "root").select("fp", "root", "component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 3, size: int = 3, node: int = NODE) -> DataFrame:
    """(`key`, fp, component): every document with the least id of the documents that links reach.

    Rows with a null or empty text have fingerprint zero and are linked as such. Repeated rows
    stay repeated. A null id takes part, but is a component's only where it has no other.
    """
    known = stored(fingerprints(docs, key, text, size))
    return known.join(_classes(known, key, budget, node), "fp").select(key, "fp", "component")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 3, size: int = 3, node: int = NODE) -> DataFrame:
    """One row of `docs` for each component, that with the least id, with all its columns.

    Where an id is null or stands in several rows it can't tell which row is meant; such rows
    meet their component by their text's fingerprint, and of those with the component's id the
    least text stays.
    """
    known = stored(fingerprints(docs, key, text, size))
    return keep_first(docs, key, text, known, _classes(known, key, budget, node), lambda rows: fingerprints(rows, "_t", "_t", size))


def keep_first(docs: DataFrame, key: str, text: str, known: DataFrame, class_of: DataFrame, marked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that `deduplicated` keeps. known: (`key`, fp) of each row; class_of: (fp, root,
    component); marked: (_t, fp) for a table of texts _t."""
    known = known.join(class_of, "fp")
    unclear = stored(known.groupBy(key).agg(F.count("*").alias("rows"), F.first("component").alias("c")).where((F.col("rows") > 1) | F.col(key).isNull()).select(key))
    gone = known.where(F.col(key) != F.col("component")).select(key).unionByName(unclear.where(F.col(key).isNotNull())).distinct()
    clear = docs.where(F.col(key).isNotNull()).join(gone, key, "left_anti").select(*docs.columns)
    if not unclear.limit(1).count():
        return clear
    # The row goes along as one column, so that no column of its own can clash.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_k"), F.col(text).alias("_t"))
    rows = rows.join(unclear.select(F.col(key).alias("_m")), F.col("_k").eqNullSafe(F.col("_m")), "left_semi")
    by_text = marked(rows.select("_t").distinct()).join(class_of, "fp").select(F.col("_t").alias("_u"), "root", "component")
    rows = rows.join(by_text, F.col("_t").eqNullSafe(F.col("_u")))
    rows = rows.where(F.col("_k").eqNullSafe(F.col("component")))
    # One id may name several groups, or none.
    first = Window.partitionBy("root").orderBy("_t")
    return clear.unionByName(rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_row.*"))


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
