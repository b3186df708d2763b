"""Spot signatures against plain Python, edits, and the join against all pairs."""

import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from binflow.llm import spotsigs

RARE = [w for w in spotsigs.WORDS if w not in spotsigs.ANCHORS]


def plain(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    every = list(words)
    words = [w for w in words if w not in RARE]
    words = [w for i, w in enumerate(words) if not (w in spotsigs.ANCHORS and i + 1 < len(words) and words[i + 1] in spotsigs.ANCHORS)]
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][:2]
            # The last words may be an anchor only.
            if len(chain) == 2:
                out.add(":".join([w, *chain]))
            elif words[i + 1 :] and len(words[i + 1 :]) == 2:
                out.add(":".join([w, *words[i + 1 : i + 3]]))
    if not out:
        out = {":".join(words[i : i + 3]) for i in range(len(words) - 2)}
    if not out and every:
        out = {f" {' '.join(every)} "}
    return out


def texts(rng, n):
    vocabulary = spotsigs.ANCHORS[:6] + RARE[:6] + [f"w{i}" for i in range(25)]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(n)]


def hashed(spark, sets):
    flat = sorted({x for s in sets for x in s})
    rows = spark.createDataFrame([(x,) for x in flat] or [("",)], "x string").select("x", F.hash("x").alias("h")).collect()
    known = {r.x: r.h for r in rows}
    return [sorted({known[x] for x in s}) for s in sets]


EDGES = [None, "", "%% !", "one", "the", "the the a is it", "two words", "The cat, THE Cat sat on the mat!", "the " * 20_000 + "end of it", "x " * 30_000, "ÀÉ İ größe 日本 the β"]


def test_signatures(spark):
    cases = EDGES + texts(random.Random(1), 60)
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(cases)], "doc_id long, text string, s string")
    got = {r.doc_id: r.sig for r in spotsigs.with_signatures(frame, "text", "sig").collect()}
    want = hashed(spark, [plain(t) for t in cases])
    assert [got[i] for i in range(len(cases))] == want


def test_edits(spark):
    rng = random.Random(2)
    rows = [(i * 13 % 101, t) for i, t in enumerate(EDGES[:8] + texts(rng, 40) + [EDGES[8][:900], EDGES[10]])]
    rows += [(200, rows[9][1]), (201, rows[9][1]), (None, "no id")]
    got = spotsigs.fingerprint_edits(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars int")).collect()
    line = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for (i, t), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        t, after, r = t or "", after or "", by[i]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        a, b, c = plain(t), plain(edited), plain(after)
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - near(a, b)) < 1e-9 and abs(r.near_next - near(a, c)) < 1e-9
        assert int(r.fingerprint.split(":")[0]) == len(a) and len(r.edited_fingerprint.split(":")[1]) == 8 * len(b)
    assert by[200].fingerprint == by[201].fingerprint
    assert spotsigs.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_join(spark):
    rng = random.Random(3)
    sets = []
    for _ in range(25):
        base = rng.sample(range(400), rng.randint(1, 40))
        for _ in range(rng.randint(1, 3)):
            sets.append(sorted(rng.sample(base, max(1, len(base) - rng.randint(0, 4)))))
    sets += [[], [], sets[0], sets[0]]
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, s array<int>")
    near = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    least = {}
    for i, s in enumerate(sets):
        least.setdefault(tuple(s), i)
    want = {tuple(sorted((i, j))) for (a, i), (b, j) in itertools.combinations(least.items(), 2) if a and b and near(a, b) >= 0.8}
    assert {tuple(sorted((r.a, r.b))) for r in spotsigs.similar(frame, "s", "id").collect()} == want
    group = {i: i for i in range(len(sets))}
    for i, s in enumerate(sets):
        group[i] = least[tuple(s)]
    for _ in sets:
        for a, b in want:
            low = min(group[a], group[b])
            group = {k: low if v in (group[a], group[b]) else v for k, v in group.items()}
    assert {r.id: r["class"] for r in spotsigs.classes(frame, "s", "id").collect()} == group
