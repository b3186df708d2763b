"""Document fingerprints from spot signatures, with Spark expressions only.

A spot is a common word (an anchor) with the chain of content words that follows it; the
words of WORDS between them are passed over. A fingerprint is the set of a text's spot
signatures. Sets are compared by Jaccard similarity, after their lengths have shown what it
can be at most; the join deals sets to partitions of similar length first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.llm.common import query, stored, table, with_next
from binflow.llm.graph import components

#: Anchors, and further function words that are no content: fixed values, four languages.
ANCHORS = "the a is that it der die das ein ist le la les un est el los una es que".split()
WORDS = "of and to in for on was as with be by are this from or at an und in den von zu mit auf für im dem nicht et des en du pour par dans qui sur au de y se del las por con para".split()
CHAIN = 2


def _any(words: list[str]) -> str:
    return "|".join(words)


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Add `out` array<int>: the ascending hashes of the text's distinct spot signatures.

    Of a run of anchors the last counts. A text without a spot has a signature for each chain
    of words; one shorter than that, for all its words; one without letters and digits, or
    null, none.
    """
    anchor, step = _any(ANCHORS), r" ([^ ]+)"
    ahead = step + f"(?: (?:{anchor})(?= ))?{step}" * (chain - 1)
    groups = ":".join(f"${i}" for i in range(1, chain + 2))
    # The row goes along as one column, so that no column of its own can clash.
    rest = [c for c in df.columns if c != out]
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]++", " ")
    own = df.select(F.struct(*rest).alias("row"), F.concat(F.lit(" "), F.trim(plain), F.lit(" ")).alias("s"))
    bare = F.regexp_replace("s", f" (?:{_any([w for w in WORDS if w not in ANCHORS])})(?= )", "")
    own = own.withColumn("b", F.regexp_replace(bare, f" (?:{anchor})(?= (?:{anchor}) )", ""))
    mark = lambda pattern: F.regexp_extract_all(F.regexp_replace("b", pattern, f"\x01{groups}\x02"), F.lit("\x01([^\x02]*)\x02"), 1)
    own = own.withColumn("a", mark(f" ({anchor})(?={ahead})"))
    own = own.withColumn("a", F.when(F.size("a") > 0, F.col("a")).otherwise(mark(f"{step}(?={step * chain})")))
    whole = F.when(F.trim("s") != "", F.array("s")).otherwise(F.array().cast("array<string>"))
    own = own.withColumn("a", F.when(F.size("a") > 0, F.col("a")).otherwise(whole))
    return own.select(*[F.col("row")[c].alias(c) for c in rest], F.array_sort(F.array_distinct(F.transform("a", lambda x: F.hash(x)))).alias(out))


def as_text(signatures: Column) -> Column:
    """A fingerprint as text: the set's length, then eight hexadecimal digits for each member."""
    digits = F.transform(signatures, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.concat_ws(":", F.size(signatures).cast("string"), F.lower(F.array_join(digits, "")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 for two empty sets. Nothing is intersected when the
    lengths settle it."""
    n, m = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(F.least(n, m) == 0, (n == m).cast("double")).otherwise(common / (n + m - common))


def similar(df: DataFrame, signatures: str, key: str, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of different non-empty sets at least `threshold` alike; a and b are
    the least keys of their sets.

    Two such sets lie in the same or in neighbouring length partitions (each `threshold` times
    the next), and share one of their rarest members: of n members, all but threshold * n - 1.
    Equal sets are one row throughout, so copies form no pairs. Empty and null sets are like
    none; a set that no row with a key has is left out; without rows there are no pairs.
    """
    sets = df.where(F.size(signatures) > 0).select(F.col(signatures).alias("s"), F.col(key).alias("id")).groupBy("s").agg(F.min("id").alias("id")).where("id IS NOT NULL")
    sets = stored(sets.withColumn("n", F.size("s")).withColumn("part", F.floor(F.log("n") / math.log(1 / threshold) + 1e-9).cast("int")))
    each = sets.select("id", "n", "part", F.explode("s").alias("sig"))
    common = each.groupBy("sig").agg(F.count("*").alias("sets"))
    ordered = each.join(common, "sig").groupBy("id", "n", "part").agg(F.array_sort(F.collect_list(F.struct("sets", "sig"))).alias("o"))
    first = F.slice("o", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    spots = stored(ordered.select("id", "n", "part", F.explode(first).alias("x")).select("id", "n", "part", "x.sig"))
    right = spots.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("part").alias("to"), "sig")
    left = spots.select(F.col("id").alias("a"), "n", "sig", F.explode(F.array("part", F.col("part") + 1)).alias("to"))
    same = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") > F.col("a")))
    pairs = left.join(right, ["to", "sig"]).where(same & (F.col("n") >= F.col("m") * threshold - 1e-9)).select("a", "b").distinct()
    texts = sets.select("id", "s")
    pairs = pairs.join(texts.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(texts.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return pairs.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)


def classes(df: DataFrame, signatures: str, key: str, threshold: float = 0.8) -> DataFrame:
    """(`key`, class): each row with the least key that links of `similar` and equal sets reach.

    Rows with an empty set are alike, rows with a null one too. Repeated rows stay; a null key
    gets the class of its set, null where no row with a key has it.
    """
    rows = df.select(F.col(key).alias("k"), F.col(signatures).alias("s"))
    sets = rows.groupBy("s").agg(F.min("k").alias("id")).select(F.col("s").alias("set"), "id")
    roots = components(similar(rows, "s", "k", threshold).select("a", "b"))
    named = sets.join(roots, sets["id"] == roots["node"], "left").select("set", F.coalesce("root", "id").alias("class"))
    return rows.join(named, F.col("s").eqNullSafe(F.col("set"))).select(F.col("k").alias(key), "class")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, whose last quarter is the start of the next text.

    Columns: `key`, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts count as empty; the row after the last is the first; rows with one
    key follow one another in the order of their texts; a null key comes first.
    """
    own = docs.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    own = with_next(with_signatures(own, "t", "s"), key, ["t", "s"])
    n = F.char_length("t")
    tail = F.floor(n / 4).cast("int")
    own = own.select(key, "s", "next_s", n.cast("long").alias("n_chars"), F.concat(F.left("t", n - tail), F.left("next_t", tail)).alias("edited"))
    own = with_signatures(own, "edited", "e")
    return own.select(
        key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("s")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"),
    )


@query("op3_spotsigs")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
