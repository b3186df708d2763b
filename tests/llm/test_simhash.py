"""Fingerprints, the trie join and components against plain Python."""

import itertools
import random

import numpy as np
import xxhash

from binflow.llm import graph, simhash


def plain_fingerprint(text):
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    return {n: root(n) for n in nodes}


TEXTS = [
    None, "", "  \t\n", "One", "one two", "A b c d", "the cat sat on the mat and the dog", "The cat sat on the mat and the dog",
    "the cat sat on the mat and the dog\x0b\x1ctail", "ÀÉ straße İ x y z", "w " * 3000, " ".join(f"w{i}" for i in range(70_000)),
]


def test_fingerprints(spark):
    rows = [(i, t, "clash", "k") for i, t in enumerate(TEXTS)]
    got = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fp string, k string")).collect()
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


def test_walk_finds_all_pairs():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for x in base:
        for _ in range(8):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
    a = np.array(sorted(fps), np.uint64)
    got = {(int(i), int(j)) for x, y in simhash.walk(a, a, 3, chunk=64) for i, j in zip(x, y, strict=True)}
    want = {(i, j) for i, j in itertools.product(range(len(a)), repeat=2) if (int(a[i]) ^ int(a[j])).bit_count() <= 3}
    assert got == want


def test_links_split_nodes(spark):
    rng = random.Random(7)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 6)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
    crowd = rng.getrandbits(64)
    fps |= {crowd ^ (1 << b) for b in range(40)}
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in sorted(fps)]
    edges = [(a, b) for a, b in itertools.combinations([s[0] for s in signed], 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    want = plain_components([s[0] for s in signed], edges)
    for node in (8, 50, 10_000):
        frame = spark.createDataFrame(signed, "fp long")
        got = simhash.links(frame, node=node).collect()
        assert {(r.a, r.b) for r in got} <= set(edges) | {(b, a) for a, b in edges}
        assert plain_components([s[0] for s in signed], [(r.a, r.b) for r in got]) == want


def test_near_duplicates(spark):
    rng = random.Random(3)
    docs = []
    for i in range(30):
        words = [f"w{rng.randint(0, 500)}" for _ in range(200)]
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(200)] = "x"
            docs.append((len(docs) + 5, " ".join(words)))
    docs += [(500, None), (501, ""), (502, None), (503, docs[0][1]), (503, docs[0][1])]
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, component string")
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(frame, node=20).collect())
    fps = {d: plain_fingerprint(t) for d, t in docs}
    edges = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = plain_components(fps, edges)
    assert got == sorted((d, fps[d], want[d]) for d, _ in docs)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(40)] + [(7, 7), (300, 1000), (1000, 300)] + [(400, k) for k in range(401, 460)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: r for n, r in plain_components(nodes, [e for e in edges if e[0] != e[1]]).items() if n != r}
    assert {n: r for n, r in got.items() if n != r} == want
