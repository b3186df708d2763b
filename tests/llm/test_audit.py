"""The filter audit against plain counting, its tries and prefixes against sorted texts."""

import random
from itertools import permutations
from pathlib import Path

import duckdb
import pytest

from binflow.llm import audit

SF = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, source string, range string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """Every order applied to every row, one filter after the other."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    rows = []
    for i, text, source in docs:
        t = text or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if i is not None and i > first[t]:
            fails.add("E")
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                total[f] += len(gone)
                redundant = sum(f in r[1] and bool(r[1] & set(order[: step - 1])) for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def result(spark, docs, labels, **more):
    frame = spark.createDataFrame([(*d, "x", 9) for d in docs], DOCS).repartition(3)
    got = audit.audit(frame, spark.createDataFrame(labels, LABELS), **more).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in got}


def texts(rng, n):
    words = [f"w{i}" for i in range(200)] + ["Ab", "CD", "#", "50%", "é", "日本"]
    shared = " ".join(rng.choices(words, k=300))
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            out.append(shared + " " + " ".join(rng.choices(words[:8], k=rng.randint(0, 3))))
        elif kind < 0.5:
            out.append(rng.choice(["", None, "x", "X", "x y", " ", "\x00", "same " * 100]))
        else:
            out.append(" ".join(rng.sample(words, rng.randint(40, 60))))
    return out


@pytest.mark.parametrize("range_bytes", [audit.RANGE_BYTES, 500])
def test_against_plain(spark, range_bytes):
    rng = random.Random(3)
    docs = [(rng.choice([None, i, i, i, i % 7, -i]), t, rng.choice([None, "", "a", "b"])) for i, t in enumerate(texts(rng, 160))]
    docs += [(1000 + i, "the same text for all", "hot") for i in range(80)] + [docs[5]] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 1080, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    assert result(spark, docs, labels, range_bytes=range_bytes) == plain(docs, labels)


def test_empty_and_single(spark):
    assert result(spark, [], []) == {}
    assert result(spark, [(1, None, None)], []) == plain([(1, None, None)], [])
    long = "word " * 400_000
    docs = [(2, long, "a"), (1, long, "a"), (3, long + "x", "a")]
    assert result(spark, docs, [(2, 1, 1)]) == plain(docs, [(2, 1, 1)])


def test_trie():
    rng = random.Random(1)
    found = ["".join(rng.choices("ab", k=rng.randint(0, 9))).encode() for _ in range(2000)]
    root, nodes = audit.Node(b""), {}
    for i, t in enumerate(found):
        node = audit.insert(root, t, 5000 - i)
        assert nodes.setdefault(t, node) is node
    least = {}
    for i, t in enumerate(found):
        least[t] = 5000 - i
    assert {t: n.least for t, n in nodes.items()} == least
    assert sorted(n.least for n in audit.terminals(root)) == sorted(least.values())


def test_prefixes_split_what_is_crowded(spark):
    """Texts that share a passage longer than a round looks ahead still go to many ranges."""
    shared = "license " * 1000
    rows = [(f"{shared}{i:05d} body",) for i in range(4000)] + [("z",)] * 1000
    cuts = audit.prefix_cuts(spark.createDataFrame(rows, "text string"), "text", 1 << 20)
    ranges = audit.Ranges(cuts)
    assert ranges.starts == sorted(ranges.starts) and ranges.count > 20
    load = {}
    for (t,) in rows:
        load[ranges.of(t.encode())] = load.get(ranges.of(t.encode()), 0) + len(t)
    assert max(load.values()) < 4 << 20


def test_longest_prefix_is_dealt_by_hash(spark):
    """What shares more than the longest prefix needs few rounds and still isn't one range."""
    shared = "x" * 3 * audit.LONGEST
    ranges = audit.Ranges(audit.prefix_cuts(spark.createDataFrame([(shared + str(i),) for i in range(200)] + [("a",), ("z",)], "text string"), "text"))
    assert len({ranges.of(f"{shared}{i}".encode()) for i in range(200)}) > 1
    assert ranges.of(b"") == ranges.of(b"a") == 0 and ranges.of(b"z") == ranges.count - 1


@pytest.mark.skipif(not SF.exists(), reason="benchmark tables not present")
def test_query_against_sql(spark):
    from binflow.llm.common import ORACLES, QUERIES

    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = QUERIES["op11_filter_audit"](spark, str(SF))
    want = db.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES['op11_filter_audit']})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(want)
