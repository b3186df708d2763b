"""Spaced seeds against a brute force over all diagonals, and planted leaks."""

import math
import random
import re
from itertools import combinations

import pytest

from binflow.llm import decontaminate as dc


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def any_stretch(equal, least):
    """Whether a stretch of `least` tokens or more, from an equal token to an equal one, has 80% equal ones."""
    n = len(equal)
    return any(equal[i] and equal[j - 1] and 5 * sum(equal[i:j]) >= 4 * (j - i) for i in range(n) for j in range(i + max(1, least), n + 1))


def plain(text, item):
    """Whether any diagonal has a long enough stretch."""
    t, own = tokens(text), tokens(item)
    if len(own) < dc.SHORTEST_ITEM:
        return False
    for shift in range(-len(own) + 1, len(t)):
        lo, hi = max(0, -shift), min(len(own), len(t) - shift)
        equal = [own[k] == t[k + shift] for k in range(lo, hi)]
        if len(own) < dc.SPAN:
            if sum(equal) == len(own):
                return True
        elif sum(equal) >= 4 and any_stretch(equal, min(dc.LEAST_TOKENS, math.ceil(dc.LEAST_SHARE * len(own) - 1e-9))):
            return True
    return False


def word(rng):
    return "".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))


def made(rng):
    items = [" ".join(word(rng) for _ in range(n)) for n in (5, 6, 7, 12, 20, 40)] + ["too short", ""]
    docs = []
    for i in range(60):
        filler = [word(rng) for _ in range(rng.randint(0, 60))]
        if i % 2:
            part = rng.choice(items[:6]).split()
            if i % 4 == 1 and len(part) >= 12:
                part[rng.randrange(len(part))] = "changed"
            if i % 6 == 1:
                part = part[: rng.randint(1, len(part))]
            filler[rng.randint(0, len(filler)) :] = [w.upper() + "," for w in part] + filler[-3:]
        docs.append(" ".join(filler))
    return items, docs


def test_token_hashes(monkeypatch):
    text = "Hello, hello HELLO x1 ÀÉ àé _a_ a" + " zz" * 50
    for piece in (5, 1 << 20):
        monkeypatch.setattr(dc, "PIECE", piece)
        h = dc.token_hashes(text).tolist()
        assert [[a == b for b in h] for a in h] == [[a == b for b in tokens(text)] for a in tokens(text)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(seed):
    items, docs = made(random.Random(seed))
    index = dc.Index(list(enumerate(items)))
    for d in docs:
        assert [r[0] for r in index.overlaps(d)] == [i for i, t in enumerate(items) if plain(d, t)]


def test_frames(spark):
    items, docs = made(random.Random(9))
    rows = [(i, d, "c") for i, d in enumerate(docs)] + [(900, None, None), (900, None, None), (901, "", "x"), (None, items[5], "y"), (902, "w " * 50_000 + items[4], "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*enumerate(items), (50, items[3]), (51, None), (None, items[4])], "item_id long, text string")
    named = [*enumerate(items), (50, items[3]), (None, items[4])]
    want = sorted((str(i), str(k)) for i, d, _ in rows for k, t in named if plain(d if i != 902 else d[-300:], t))
    for size in (dc.BLOCK_BYTES, 200):
        got = dc.leaks(frame, bench, block_bytes=size).collect()
        assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == want
        assert all(r.equal >= 0.8 * r.overlap for r in got)
        kept = dc.clean(frame, bench, block_bytes=size)
        assert kept.columns == frame.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, _ in rows if str(i) not in {w[0] for w in want})
    assert dc.leaks(frame, bench.limit(0)).count() == 0 and dc.clean(frame, bench.limit(0)).count() == len(rows)
    assert dc.leaks(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("n, places", [(15, (3,)), (15, (10,)), (15, (11,)), (16, (12,)), (17, (12,)), (40, (4, 9, 14, 19, 24, 29, 34, 39))])
def test_whole_items_with_replaced_tokens(n, places):
    item = [f"t{i}" for i in range(n)]
    text = ["before", *("x" if i in places else w for i, w in enumerate(item)), "after"]
    (row,) = dc.Index([(1, " ".join(item))]).overlaps(" ".join(text))
    assert row[1:4] == (1, places[-1] if places[-1] == n - 1 else n, n - len(places))


def test_longest_stretch():
    import numpy as np

    rng = random.Random(4)
    for _ in range(400):
        equal = [rng.random() < 0.75 for _ in range(rng.randint(0, 40))]
        i, j = dc.longest_stretch(np.array(equal, bool))
        assert (j == i) == (not any(equal)) and not any_stretch(equal, j - i + 1)
        assert j == i or equal[i] and equal[j - 1] and 5 * sum(equal[i:j]) >= 4 * (j - i)


def test_every_leak_of_a_short_item_is_found():
    """Items of 8 to 12 tokens: all ways to replace tokens that the rule still calls a leak."""
    for n in range(dc.SPAN, dc.SHORT_ITEM + 1):
        item = [f"t{i}" for i in range(n)]
        index = dc.Index([(1, " ".join(item))])
        for k in range(4):
            for places in combinations(range(n), k):
                text = " ".join(["before", *("x" if i in places else w for i, w in enumerate(item)), "after"])
                assert bool(index.overlaps(text)) == plain(text, " ".join(item)), (n, places)


def test_items_without_an_id_count(spark):
    item = " ".join(f"t{i}" for i in range(20))
    frame, bench = spark.createDataFrame([(1, f"x {item} y"), (2, "z")], "doc_id long, text string"), spark.createDataFrame([(None, item)], "item_id long, text string")
    assert [tuple(r)[:3] for r in dc.leaks(frame, bench).collect()] == [(1, None, 1)]
    assert [r.doc_id for r in dc.clean(frame, bench).collect()] == [2]


def test_index_size():
    """The bytes of an index that BLOCK_BYTES reckons with."""
    import pickle

    rng = random.Random(3)
    items = [(i, " ".join(word(rng) + str(rng.randint(0, 999)) for _ in range(60))) for i in range(2000)]
    assert len(pickle.dumps(dc.Index(items))) < 25 * sum(len(t) for _, t in items)
