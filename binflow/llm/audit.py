"""Audit of how filters interact: what each takes in every order in which they can be applied.

Four filters look at one text; the fifth, exact copies, needs the whole table. It is found with
radix tries. A task first inserts the texts it reads into a compressed trie whose terminals hold
the least id; a row with a larger id is a copy at once, so a group of copies leaves each task as
one row. What is left goes to ranges of texts, cut by prefixes that grow only where many bytes
share them, and each range is a trie again. Every row becomes a mask of the filters it fails,
and all counts of all orders follow from the number of rows of each mask.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, permutations
from math import factorial
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.llm.common import query, table

LETTERS = "ABCDE"
#: A: fewer words; B: a lower percentage of distinct words; C: a higher one of capitals; D: holds one of these.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: Text of a range of the second tries, in bytes: at most so much, and no less than LEAST_BYTES for
#: the sake of more tasks.
RANGE_BYTES, LEAST_BYTES = 32 << 20, 4 << 20
#: Bytes after a crowded prefix that a round looks at, at first and at most. What shares more than
#: the longest prefix is dealt further by a hash of the whole text.
AHEAD, MOST_AHEAD, LONGEST = 32, 4096, 1 << 14
ROW_BYTES = 64
#: How many first bytes of `lo` and `hi` are equal, by halving steps.
SHARED = (
    f"aggregate(array({', '.join(str(MOST_AHEAD >> i) for i in range(MOST_AHEAD.bit_length()))}), 0, "
    "(n, step) -> if(octet_length(lo) >= n + step and substring(lo, 1, n + step) = substring(hi, 1, n + step), n + step, n))"
)


class Node:
    """A node of a compressed trie: the bytes that lead to it, its children by their first byte,
    the least id of the texts that end here and what came with them."""

    __slots__ = ("edge", "children", "least", "rows")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.least, self.rows = edge, {}, None, []


def _shared(edge: bytes, text: bytes, at: int) -> int:
    """How many bytes of `edge` are at `at` in `text`; the first is, not all are."""
    lo, hi = 1, len(edge)
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if text.startswith(edge[:mid], at) else (lo, mid)
    return lo


def insert(root: Node, text: bytes, key: int) -> Node:
    """The terminal of a whole text, whose least id then is no more than `key`."""
    node, at = root, 0
    while at < len(text):
        child = node.children.get(text[at])
        if child is None:
            child = node.children[text[at]] = Node(text[at:])
            node, at = child, len(text)
        elif text.startswith(child.edge, at):
            node, at = child, at + len(child.edge)
        else:
            k = _shared(child.edge, text, at)
            fork = node.children[text[at]] = Node(child.edge[:k])
            child.edge = child.edge[k:]
            fork.children[child.edge[0]] = child
            node, at = fork, at + k
    if node.least is None or key < node.least:
        node.least = key
    return node


def terminals(root: Node) -> Iterator[Node]:
    """The nodes at which texts end."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.least is not None:
            yield node
        stack += node.children.values()


def conditions(text: bytes, n_chars: int) -> int:
    """Bits 0 to 3: the filters A to D that a text fails."""
    words = text.split()
    short = len(words) < LEAST_WORDS
    same = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * n_chars
    signs = len(text) != len(text.translate(None, SIGNS))
    return short | same << 1 | loud << 2 | signs << 3


COPY = 1 << 4


def prefix_cuts(docs: DataFrame, text: str, range_bytes: int = RANGE_BYTES) -> list[tuple[bytes, int]]:
    """Ascending prefixes that cut the texts into ranges of about equal bytes, each with the
    number of parts into which a hash of the text deals what is behind it.

    A round counts the bytes behind every next byte of each crowded prefix; a crowded child
    moves on to the end of what all its texts share, and looks further ahead each time that a
    round saw nothing else. A prefix that is one text is not cut. The driver holds crowded
    prefixes, of which there are no more than ranges, and their children.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(whole.alias("b")).withColumn("w", F.octet_length("b") + ROW_BYTES)
    total = rows.agg(F.sum("w")).first()[0] or 0
    parts = max(-(-total // range_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // min(LEAST_BYTES, range_bytes))))
    crowd = total // max(1, parts)
    waiting, leaves = [(b"", AHEAD)] if total else [], []
    while waiting:
        now = sorted(waiting, key=lambda x: len(x[0]))
        lengths = [len(p) for p, _ in now]
        places = []
        for n in sorted(set(lengths)):
            held = ", ".join(f"X'{p.hex()}'" for p, _ in now if len(p) == n)
            places.append(f"{lengths.index(n)} + nullif(array_position(array({held}), substring(b, 1, {n})), 0)")
        near = rows.withColumn("i", F.expr(f"coalesce({', '.join(places)})")).where("i IS NOT NULL")
        near = near.withColumns({"l": F.expr(f"element_at(array({', '.join(map(str, lengths))}), int(i))"), "a": F.expr(f"element_at(array({', '.join(str(a) for _, a in now)}), int(i))")})
        near = near.select("i", "l", "a", "w", F.expr("substring(b, l + 1, 1)").alias("c"), F.expr("substring(b, l + 1, a)").alias("t"))
        child = near.groupBy("i", "l", "a", "c").agg(F.sum("w").alias("w"), F.min("t").alias("lo"), F.max("t").alias("hi"))
        # The longest common prefix of the least and the greatest text is that of all.
        child = child.withColumn("same", F.expr(SHARED))
        crowded = (F.col("w") > crowd) & ((F.col("lo") != F.col("hi")) | (F.octet_length("lo") == F.col("a")))
        more = crowded & (F.col("l") + F.col("same") < LONGEST)
        waiting = []
        for r in child.select("i", "c", "w", "same", crowded.alias("crowded"), more.alias("more"), F.when(more, F.expr("substring(lo, 1, same)")).alias("p")).collect():
            prefix, ahead = now[r["i"] - 1]
            if r["more"]:
                waiting.append((prefix + bytes(r["p"]), min(MOST_AHEAD, ahead * 8) if r["same"] == ahead else AHEAD))
            else:
                leaves.append((prefix + bytes(r["c"]), r["w"], -(-r["w"] // max(1, crowd)) if r["crowded"] else 1))
    cuts, held = [], 0
    for prefix, w, deal in sorted(leaves):
        if held + w > crowd or deal > 1 or not cuts or cuts[-1][1] > 1:
            cuts.append((prefix if cuts else b"", deal))
            held = 0
        held += w
    return cuts or [(b"", 1)]


class Ranges:
    """The number of the range of a text, from its prefix and, where that says too little, its hash."""

    def __init__(self, cuts: list[tuple[bytes, int]]):
        self.starts, self.deal = [p for p, _ in cuts], [d for _, d in cuts]
        self.first = [0, *accumulate(self.deal)]
        self.count = self.first[-1]

    def of(self, text: bytes) -> int:
        k = bisect_right(self.starts, text) - 1
        return self.first[k] + (crc32(text) % self.deal[k] if self.deal[k] > 1 else 0)


FIELDS = [("id", pa.int64()), ("source", pa.string()), ("mask", pa.int32()), ("n", pa.int64())]
DDL = "id bigint, source string, mask int, n bigint"


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def failed_filters(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, source, mask, n): the filters that rows fail, bit 0 for A to bit 4 for E.

    n: how many equal rows a row stands for. A null text is empty. Rows with equal ids are no
    copies of one another; a row with a null id is a copy of none and none is a copy of it.
    Other columns of `docs` are not read; an empty table gives no rows.
    """
    ranges = Ranges(prefix_cuts(docs, text, range_bytes))
    parts = ranges.count
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"), whole.cast("binary").alias("b"), F.char_length(whole).alias("n"))
    fields = [*FIELDS, ("range", pa.int32()), ("b", pa.binary())]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources, lengths = (batch.column(k).to_pylist() for k in (0, 1, 3))
            root, out = Node(b""), []
            for i, (key, text) in enumerate(zip(ids, batch.column(2), strict=True)):
                text = text.as_py()
                if key is None:
                    out.append((None, sources[i], conditions(text, lengths[i]), 1, i % parts, None))
                    continue
                node = insert(root, text, key)
                if not node.rows:
                    node.rows = [conditions(text, lengths[i]), [], i]
                node.rows[1].append(i)
            for node in terminals(root):
                mask, members, sample = node.rows
                first: dict[str | None, int] = {}
                for i in members:
                    if ids[i] == node.least:
                        first[sources[i]] = first.get(sources[i], 0) + 1
                    else:
                        out.append((ids[i], sources[i], mask | COPY, 1, i % parts, None))
                text = batch.column(2)[sample].as_py()
                to = ranges.of(text)
                out += [(node.least, name, mask, n, to, text) for name, n in first.items()]
            for at in range(0, len(out), 4096):
                yield _batch(out[at : at + 4096], fields)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Node(b"")
        for batch in batches:
            yield batch.filter(batch.column(5).is_null()).select([0, 1, 2, 3])
            rest = batch.filter(batch.column(5).is_valid())
            for key, name, mask, n, text in zip(*(rest.column(k).to_pylist() for k in (0, 1, 2, 3)), rest.column(5), strict=True):
                insert(root, text.as_py(), key).rows.append((key, name, mask, n))
        out = []
        for node in terminals(root):
            out += [(key, name, mask | COPY * (key > node.least), n) for key, name, mask, n in node.rows]
            if len(out) >= 4096:
                yield _batch(out, FIELDS)
                out = []
        yield _batch(out, FIELDS)

    dealt = rows.mapInArrow(local, f"{DDL}, range int, b binary").repartitionById(parts, "range")
    return dealt.mapInArrow(merged, DDL)


def audited(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Counts of each filter in each order, for each part.

    masks: (part, mask, n, good, toxic), n rows that fail the filters of a mask, good and toxic
    of them labelled so. Nothing but the sums of each mask is needed: free[S], the rows that
    pass all filters of a set S, gives what each step of each order takes.
    """
    k = len(letters)
    sums = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    parts = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"))
    every, counts = f"sequence(0, {2**k - 1})", ("n", "good", "toxic")
    parts = parts.select("part", *[F.expr(f"transform({every}, x -> coalesce(m[x].{c}, 0L))").alias(f"of_{c}") for c in counts])
    passing = "transform({0}, s -> aggregate(filter({1}, (x, i) -> (i & s) = 0), 0L, (a, x) -> a + x))"
    parts = parts.select("*", *[F.expr(passing.format(every, f"of_{c}")).alias(f"free_{c}") for c in counts])
    # A set of filters that misses f comes before it in so many orders; what f then takes is free[S] - free[S and f].
    orders_of = lambda s: factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())
    weights = [[-orders_of(s ^ 1 << f) if s >> f & 1 else orders_of(s) for s in range(2**k)] for f in range(k)]
    long_array = lambda ws: "array(" + ", ".join(f"{w}L" for w in ws) + ")"
    shares = [F.expr(f"aggregate(zip_with(free_n, {long_array(ws)}, (x, w) -> x * w), 0L, (a, x) -> a + x)") for ws in weights]
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    steps = parts.select("*", F.array(*shares).alias("shapleys"), F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = "shiftleft(1, instr('{0}', {1}) - 1)"
    before = f"aggregate(sequence(1, step), 0, (s, i) -> if(i < step, s | {bit.format(letters, 'substring(filter_order, i, 1)')}, s))"
    letter = "substring(filter_order, step, 1)"
    steps = steps.select("*", F.expr(f"instr('{letters}', {letter}) - 1").alias("f"), F.expr(bit.format(letters, letter)).alias("bit"), F.expr(before).alias("s"))
    after = F.col("s").bitwiseOR(F.col("bit"))
    free = lambda c, s: F.col(f"free_{c}")[s]
    gone = lambda c: free(c, F.col("s")) - free(c, after)
    return steps.select(
        "part", "filter_order", "step",
        free("n", after).alias("kept"),
        gone("n").alias("removed"),
        (free("n", F.lit(0)) - free("n", F.col("bit")) - gone("n")).alias("redundant"),
        F.col("of_n")[F.col("bit")].alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.col("shapleys")[F.col("f")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The audit of all rows of `docs`, one part for each source, a null one under the empty string.

    labels: (`key`, quality, toxic). A document that several rows label is good or toxic if one
    of them says so; those without a label are neither. Without documents there are no rows.
    """
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = failed_filters(docs, key, text, source, range_bytes).join(known, "id", "left")
    share = lambda c: F.when(F.col(c) == 1, F.col("n")).otherwise(0)
    return audited(rows.select(F.coalesce("source", F.lit("")).alias("part"), "mask", "n", share("quality").alias("good"), share("toxic").alias("toxic")))


SQL = """
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), l AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN coalesce(w.doc_id > first_id, false) THEN 'E' ELSE '' END AS fails
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), m AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), orders AS (
    SELECT a.c || b.c || d.c || e.c || g.c AS filter_order
    FROM letters a, letters b, letters d, letters e, letters g
    WHERE a.c NOT IN (b.c, d.c, e.c, g.c) AND b.c NOT IN (d.c, e.c, g.c) AND d.c NOT IN (e.c, g.c) AND e.c <> g.c
), steps AS (
    SELECT filter_order, s AS step, filter_order[s] AS c, filter_order[1:s - 1] AS before
    FROM orders, generate_series(1, 5) AS x(s)
), counted AS (
    SELECT part, filter_order, step, c,
        CAST(coalesce(sum(n) FILTER (WHERE NOT earlier AND NOT here), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (WHERE NOT earlier AND here), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (WHERE earlier AND here), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (WHERE fails = c), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (WHERE NOT earlier AND here), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(toxic) FILTER (WHERE NOT earlier AND here), 0) AS BIGINT) AS toxic_lost
    FROM (SELECT *, contains(fails, c) AS here, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS earlier FROM m, steps)
    GROUP BY part, filter_order, step, c
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM counted
"""


@query("op11_filter_audit", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
