"""Secret scans with a random forest for false positives, in DataFrame operations only.

Candidates are long runs of token characters that hold a digit, and quoted values after an
assignment. A forest over their length, character transitions, dictionary coverage, path and
neighbouring words, trained from labelled findings, tells secrets from the rest.
"""

from __future__ import annotations

from pyspark.ml import functions as MF
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.llm.common import query, stored, table

#: What a candidate looks like.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
    r"|(?<=[=:] {0,2}[\"'])[^\"'\s]{8,}+(?=[\"'])"
)
#: Words that name a credential, and words that mark an example.
CREDENTIAL = r"(?i)(token|secret|passw|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)"
EXAMPLE = r"(?i)(example|sample|dummy|test|placeholder|changeme|your[_-])"
#: Characters of text kept on either side of a candidate.
AROUND = 60
#: Labelled findings that the forest learns from, at most; taken by the hash of their content.
TRAINING_ROWS = 10_000
#: A word counts as known from so many documents on.
LEAST_DOCUMENTS = 3
BUCKETS = 16
MASK = "[secret]"
LETTERS = "[a-z]"


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(`key`, text_hash, n, start, value, before, after, path): a row for each candidate.

    n: its place among the text's candidates, from 0; start: its first code point, from 0.
    Texts without one, null or empty, give none. text_hash tells apart rows with one key.
    Repeated rows repeat their candidates; a null key or path stays null.
    """
    held = docs.where(F.col(text).rlike(CANDIDATE)).select(
        F.col(key), F.xxhash64(text).alias("text_hash"), F.col(path).cast("string").alias("path"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("values"), F.split(text, CANDIDATE, -1).alias("parts"),
    )
    starts = F.aggregate(
        F.sequence(F.lit(0), F.size("values") - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, i: F.struct(
            (a["at"] + F.char_length(F.get("parts", i)) + F.char_length(F.get("values", i))).alias("at"),
            F.array_append(a["all"], a["at"] + F.char_length(F.get("parts", i))).alias("all"),
        ),
        lambda a: a["all"],
    )
    # One struct for each candidate, so that no exploded row carries the lists.
    count = F.size("values")
    before = F.transform(F.slice("parts", 1, count), lambda p: F.right(p, F.lit(AROUND)))
    after = F.transform(F.slice("parts", 2, count), lambda p: F.left(p, F.lit(AROUND)))
    each = held.select(F.col(key).alias("k"), "text_hash", "path", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("values").alias("value"), before.alias("before"), after.alias("after"))).alias("n", "c"))
    return each.select(F.col("k").alias(key), "text_hash", "n", "c.start", "c.value", "c.before", "c.after", "path")


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, documents): the words of 3 to 20 letters that at least LEAST_DOCUMENTS texts have."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?<!{LETTERS}){LETTERS}{{3,20}}+(?!{LETTERS})"), 0))
    counts = docs.where(F.col(text).isNotNull()).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("documents"))
    return counts.where(F.col("documents") >= LEAST_DOCUMENTS)


def transitions(words: DataFrame) -> DataFrame:
    """(pair, cost): minus the log probability of a letter after another, smoothed, in the
    dictionary's words; at most 26 * 26 rows."""
    pairs = words.select("documents", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum("documents").alias("c"))
    first = counts.groupBy(F.left("pair", F.lit(1)).alias("a")).agg(F.sum("c").alias("all"))
    joined = counts.join(F.broadcast(first), F.left("pair", F.lit(1)) == F.col("a"))
    return joined.select("pair", (-F.log((F.col("c") + 1) / (F.col("all") + 26))).alias("cost"))


#: The cost of a pair of letters that the dictionary lacks.
UNSEEN = 8.0


def value_features(values: DataFrame, words: DataFrame) -> DataFrame:
    """(value, covered, cost): of each distinct value, the share of its characters in dictionary
    words, and the mean cost of its letter pairs."""
    low = values.select("value", F.lower("value").alias("v"))
    runs = low.select("value", F.explode(F.regexp_extract_all("v", F.lit(f"{LETTERS}{{3,}}+"), 0)).alias("word"))
    known = runs.join(words.select("word"), "word").groupBy("value").agg(F.sum(F.length("word")).alias("hit"))
    pieces = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("v") - 1, F.lit(1))), lambda i: F.substring("v", i, 2)), lambda p: p.rlike(f"^{LETTERS}{{2}}$"))
    cost = low.select("value", F.explode(pieces).alias("pair")).join(F.broadcast(transitions(words)), "pair", "left")
    cost = cost.groupBy("value").agg(F.avg(F.coalesce("cost", F.lit(UNSEEN))).alias("cost"))
    return values.join(known, "value", "left").join(cost, "value", "left").select(
        "value", F.coalesce(F.col("hit") / F.length("value"), F.lit(0.0)).alias("covered"), F.coalesce("cost", F.lit(UNSEEN)).alias("cost")
    )


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """`found` with a vector column x of its features."""
    more = value_features(found.select("value").distinct(), words)
    near = F.array_except(F.split(F.lower(F.concat_ws(" ", F.right("before", F.lit(30)), F.left("after", F.lit(15)))), "[^a-z]+"), F.array(F.lit("")))
    columns = {
        "length": F.length("value"),
        "changes": _share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"),
        "digits": _share("[0-9]"), "upper": _share("[A-Z]"), "hex": _share("[0-9a-f]"), "other": _share("[^A-Za-z0-9]"),
        "kinds": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
        "covered": F.col("covered"), "cost": F.col("cost"),
        "path_depth": F.size(F.split(F.coalesce("path", F.lit("")), "/")),
        "path_example": F.coalesce("path", F.lit("")).rlike(r"(?i)(test|example|sample|doc|fixture|mock|\.lock|\.md)").cast("int"),
        "path_config": F.coalesce("path", F.lit("")).rlike(r"(?i)(\.env|conf|\.ya?ml|\.json|\.ini|\.properties|\.pem|secret|deploy)").cast("int"),
        "named": F.right("before", F.lit(30)).rlike(CREDENTIAL).cast("int"), "example": F.concat("before", "value").rlike(EXAMPLE).cast("int"),
        "assigned": F.col("before").rlike(r"[=:]\s{0,2}[\"']?$").cast("int"), "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("int"),
    }
    columns |= {f"near{k}": F.array_contains("_near", F.lit(k).cast("long")).cast("int") for k in range(BUCKETS)}
    out = found.join(more, "value").withColumn("_near", F.transform(near, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS).cast("long")))).withColumns({f"_{name}": c.cast("double") for name, c in columns.items()})
    names = [f"_{name}" for name in columns]
    return VectorAssembler(inputCols=names, outputCol="x").transform(out).drop(*names, "covered", "cost", "_near")


def reviewed(found: DataFrame) -> DataFrame:
    """`found` with label: what a reviewer's fixed rules settle, null where they don't.

    1: a value of 20 characters and more with digits and letters in equal measure, assigned to a
    name of a credential, no example. 0: digits only, or a word with a number, unassigned.
    """
    letters, digits = F.regexp_count("value", F.lit("[A-Za-z]")), F.regexp_count("value", F.lit("[0-9]"))
    named = F.right("before", F.lit(30)).rlike(CREDENTIAL) & F.col("before").rlike(r"[=:]\s{0,2}[\"']?$")
    mixed = (F.length("value") >= 20) & (digits * 5 >= F.length("value")) & (letters * 5 >= F.length("value"))
    yes = named & mixed & ~F.concat("before", "value").rlike(EXAMPLE)
    no = (letters == 0) | (~named & (digits <= 4))
    return found.withColumn("label", F.when(yes, 1.0).when(no, 0.0))


def train(labelled: DataFrame):
    """A forest from rows (value, before, after, label, x), or None unless both labels occur.

    At most TRAINING_ROWS different rows, half of each label where there are enough, chosen and
    ordered by a hash of their content: the same findings give the same forest however they are
    dealt, and copies of a finding count once.
    """
    order = [F.xxhash64("value", "before", "after"), F.col("value"), F.col("before"), F.col("after")]
    known = labelled.where(F.col("label").isNotNull()).select("label", "x", "value", "before", "after").dropDuplicates(["label", "value", "before", "after"])
    halves = [known.where(F.col("label") == k).orderBy(*order).limit(TRAINING_ROWS // 2) for k in (0.0, 1.0)]
    rows = stored(halves[0].unionByName(halves[1]).select("label", "x", *[o.alias(f"o{i}") for i, o in enumerate(order)]).coalesce(1).sortWithinPartitions("label", "o0", "o1", "o2", "o3"))
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="x", numTrees=24, maxDepth=6, seed=7, minInstancesPerNode=2).fit(rows.select("label", "x").coalesce(1))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """(`key`, text_hash, n, start, value, before, after, path, score, is_secret): every candidate.

    labelled: findings (value, before, after, path, label); without them the rules of `reviewed`
    label the corpus' own. Where labels of one kind are missing no forest can be learnt: a
    candidate then keeps its label, and counts as a secret if it has none.
    """
    found = stored(candidates(docs, key, text, path))
    words = stored(dictionary(docs, text))
    ours = stored(reviewed(features(found, words)))
    model = train(ours if labelled is None else features(labelled, words))
    keep = [key, "text_hash", "n", "start", "value", "before", "after", "path"]
    if model is None:
        out = ours.select(*keep, F.coalesce("label", F.lit(1.0)).alias("score"))
    else:
        out = model.transform(ours).select(*keep, MF.vector_to_array("probability")[1].alias("score"))
    return out.withColumn("is_secret", F.col("score") >= 0.5)


def masked(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with MASK in the place of each secret; columns and rows stay as they are.

    Only texts with a candidate meet the findings; all others, null and empty ones too, pass by
    untouched. A null key meets the findings of its text. Repeated rows are all masked; an empty
    table stays empty.
    """
    has = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))
    secret = found.where("is_secret").select(F.col(key).alias("key"), F.col("text_hash").alias("hash"), "n").groupBy("key", "hash").agg(F.collect_set("n").alias("masks"))
    # The row goes along as one column, so that no column of its own can clash.
    some = docs.where(has).select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    some = some.join(secret, F.col("k").eqNullSafe(F.col("key")) & (F.col("h") == F.col("hash")), "left")
    some = some.select("row", "t", "masks", F.regexp_extract_all("t", F.lit(CANDIDATE), 0).alias("values"), F.split("t", CANDIDATE, -1).alias("parts"))
    put = F.array_join(F.transform("parts", lambda p, i: F.concat(p, F.when(F.array_contains("masks", i), F.lit(MASK)).otherwise(F.coalesce(F.get("values", i), F.lit(""))))), "")
    masked_text = F.when(F.col("masks").isNull(), F.col("t")).otherwise(put).alias(text)
    return docs.where(~has).unionByName(some.select(*[masked_text if c == text else F.col("row")[c].alias(c) for c in docs.columns]))


@query("op1_secrets")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
