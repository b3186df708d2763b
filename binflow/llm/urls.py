"""URL filter: fixed rules, and a tree of path templates for what they leave open.

Each host has a tree of path templates. A segment that is a number, a hash or a long mixed
name becomes a wildcard by its form; labelled siblings whose shares of blocked pages don't differ
significantly are merged; the children without labels of a node with many get one wildcard.
A template is rejected when its smoothed share of blocked pages is high, each node's share
being drawn towards its parent's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binflow.llm.common import query, stored, table

Rule = tuple[str, str, str]  # verdict, host, path
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: A node with more different children has a variable segment: those without labels are one.
MOST_CHILDREN = 30
#: Weight of the parent's share of blocked pages, in pages; the share that a host starts from.
WEIGHT, START = 2.0, 0.1
#: A template with at least this smoothed share is rejected.
REJECT = 0.7
#: Siblings merge below this distance, in standard deviations.
ALIKE = 1.64


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without `://`."""
    rest = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"
    text = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(text, rest, 1), upper, lower), F.regexp_extract(text, rest, 2)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null; of equally long ones block leads."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1], r[2]))
    out = None
    for verdict, name, start in order:
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        row = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, row) if out is None else out.when(fits, row)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def segments(path: Column) -> Column:
    """Path segments, variable ones generalised by their form."""
    def general(s: Column) -> Column:
        name, kind = F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        shape = (
            F.when(name.rlike(r"^[0-9]+$"), "#")
            .when(name.rlike(r"^[0-9a-fA-F-]{8,}$") & name.rlike("[0-9]"), "@")
            .when(name.rlike(r"[0-9]") & (F.length(name) > 12), "*")
            .otherwise(name)
        )
        return F.concat(shape, kind)

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)


def _groups(child: DataFrame, node: list[str]) -> DataFrame:
    """(`node`, seg, g, group): labelled siblings, with the number and the name of the group that
    they merge into.

    Siblings with one share never differ, so a window's rows are a node's different shares, each
    with the pages of its first and its last segment: neighbours meet only there.
    """
    known = child.where("k > 0").select(*node, "seg", "k", "b", (F.col("b") / F.col("k")).alias("p"))
    ends = known.groupBy(*node, "p").agg(F.min(F.struct("seg", "k", "b")).alias("lo"), F.max(F.struct("seg", "k", "b")).alias("hi"))
    line = Window.partitionBy(*node).orderBy("p")
    before = F.lag("hi").over(line)
    share = (F.col("lo.b") + before["b"]) / (F.col("lo.k") + before["k"])
    error = F.sqrt(share * (1 - share) * (1 / F.col("lo.k") + 1 / before["k"]))
    new = F.coalesce((F.col("p") - F.lag("p").over(line) > ALIKE * error).cast("int"), F.lit(0))
    ends = ends.withColumn("new", new).select(*node, "p", F.sum("new").over(line).alias("g"))
    placed = known.join(ends, [*node, "p"])
    sizes = placed.groupBy(*node, "g").agg(F.count("*").alias("size"), F.min("seg").alias("least"))
    placed = placed.join(sizes, [*node, "g"])
    # Long lists of names are cut short, their groups aren't.
    few = placed.where(F.col("size") <= MOST_CHILDREN).groupBy(*node, "g").agg(F.array_join(F.array_sort(F.collect_set("seg")), "|").alias("names"))
    named = placed.join(few, [*node, "g"], "left")
    return named.select(*node, "seg", "g", F.coalesce("names", F.concat("least", F.lit("|*"))).alias("group"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, parts, template, purity): the template of each host and generalised path, and its
    smoothed share of blocked pages.

    pages: (host, parts array<string>, blocked int or null where unlabelled). Rows are counted
    before anything else, so a host's pages never meet; a level of the tree is a round of joins.
    The tree ends where nothing below a node is labelled, which gets one wildcard `**` and the
    node's share, and where a node has one path left. Nodes are told apart by their key, the
    kinds and numbers of their groups; names are for show.
    """
    base = stored(
        pages.groupBy("host", "parts").agg(F.count("*").alias("n"), F.count("blocked").alias("known"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    )
    # What goes on below a node: its labelled pages, and its paths.
    below = lambda level: (F.sum(F.when(F.size("parts") > level, F.col("known")).otherwise(0)).alias("labelled"), F.count_if(F.size("parts") > level).alias("paths"))
    root = base.groupBy("host").agg(F.sum("known").alias("k"), F.sum("bad").alias("b"), *below(0))
    root = root.select("host", ((F.col("b") + WEIGHT * START) / (F.col("k") + WEIGHT)).alias("purity"), "labelled", "paths")
    now = stored(base.join(root, "host").withColumns({"key": F.lit(""), "template": F.lit("")}))
    node, level, ended = ["host", "key"], 0, []
    finished = lambda rows, template, purity: rows.select("host", "parts", template.alias("template"), purity.alias("purity"))
    while True:
        ended.append(finished(now.where(F.size("parts") == level), F.col("template"), F.col("purity")))
        bare, alone, deeper = F.col("labelled") == 0, F.col("paths") == 1, now.where(F.size("parts") > level)
        ended.append(finished(deeper.where(bare), F.concat("template", F.lit("/**")), F.col("purity")))
        # The share of a single path is drawn towards itself once for each segment left.
        left = F.sequence(F.lit(level + 1), F.size("parts"))
        own = F.aggregate(left, F.col("purity"), lambda up, _: (F.col("bad") + WEIGHT * up) / (F.col("known") + WEIGHT))
        rest = F.array_join(F.slice("parts", level + 1, F.size("parts")), "/")
        ended.append(finished(deeper.where(~bare & alone), F.concat_ws("/", "template", rest), own))
        going = deeper.where(~bare & ~alone).drop("labelled", "paths").withColumn("seg", F.element_at("parts", level + 1))
        if not going.limit(1).count():
            break
        level += 1
        child = going.groupBy(*node, "seg").agg(F.sum("known").alias("k"), F.sum("bad").alias("b"), F.first("purity").alias("up"), *below(level))
        fan = child.groupBy(*node).agg(F.count("*").alias("kids"))
        child = child.join(fan, node).join(_groups(child, node), [*node, "seg"], "left")
        wide = F.col("kids") > MOST_CHILDREN
        child = child.withColumn("name", F.coalesce("group", F.when(wide, "*").otherwise(F.col("seg"))))
        child = child.withColumn("mark", F.coalesce(F.concat(F.lit("g"), "g"), F.when(wide, "w").otherwise(F.concat(F.lit("s"), "seg"))))
        total = child.groupBy(*node, "mark").agg(*[F.sum(c).alias(c) for c in ("k", "b", "labelled", "paths")], F.first("up").alias("up"))
        total = total.select(*node, "mark", ((F.col("b") + WEIGHT * F.col("up")) / (F.col("k") + WEIGHT)).alias("own"), "labelled", "paths")
        named = child.select(*node, "seg", "name", "mark").join(total, [*node, "mark"])
        names = F.concat_ws("/", "key", "mark").alias("key"), F.concat_ws("/", "template", "name").alias("template")
        now = stored(going.join(named, [*node, "seg"]).select("host", "parts", "n", "known", "bad", F.col("own").alias("purity"), "labelled", "paths", *names))
    every = reduce(DataFrame.unionByName, ended)
    return every.select("host", "parts", F.concat(F.lit("/"), F.ltrim(F.col("template"), F.lit("/"))).alias("template"), "purity")


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(`key`, host, path, rule, verdict, template, purity) for every row.

    A rule's verdict stands; pages that no rule fits get their template's. The pages that rules
    settle are the labels. Null and broken urls have an empty host, a tree like any other.
    """
    host, path = parsed(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("parts", segments(F.col("path")))
    tree = templates(rows.select("host", "parts", (F.col("hit.verdict") == "block").cast("int").alias("blocked")))
    verdict = F.coalesce("hit.verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return rows.join(tree, ["host", "parts"]).select(key, "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


@query("op9_urls")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"))
