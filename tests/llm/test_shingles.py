"""The near-duplicate stage against all pairs of shingle sets."""

import itertools
import random

from test_simhash import plain_components

import corpus_pipeline
from binflow.llm import shingles


def shingle_set(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_stage_removes_all_near_copies(spark):
    rng = random.Random(2)
    texts, line = [None, "", "one two", "One  two", "a b c d e", "a b c d e f"], [f"c{i}" for i in range(20)]
    for n in (30, 100, 300):
        for _ in range(8):
            base = [f"w{rng.randint(0, 5000)}" for _ in range(n)] + line
            for _ in range(6):
                copy = list(base)
                for at in rng.sample(range(n), rng.randint(0, max(1, n // 30))):
                    copy[at] = f"x{rng.randint(0, 5000)}"
                texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = dict(enumerate(map(shingle_set, texts)))
    links = [(i, j) for i, j in itertools.combinations(sets, 2) if alike(sets[i], sets[j])]
    root = plain_components(sets, links)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()]
    assert sorted(got) == sorted(set(root.values()))


def kept_of(texts):
    sets = dict(enumerate(map(shingle_set, texts)))
    links = [(i, j) for i, j in itertools.combinations(sets, 2) if alike(sets[i], sets[j])]
    return sorted(set(plain_components(sets, links).values()))


def test_phrases_that_the_sample_misses(spark, monkeypatch):
    """Crowded buckets are ordered by exact counts: no link is lost, and few pairs are compared."""
    rng = random.Random(5)
    phrase, stock = [f"p{i}" for i in range(60)], [[f"s{k}_{i}" for i in range(20)] for k in range(6)]
    texts = []
    for i in range(260):
        own = [f"w{rng.randint(0, 50_000)}" for _ in range(70)]
        texts.append(" ".join(own[:35] + phrase + own[35:]))
        if i % 20 == 0:
            own[3] = "changed"
            texts.append(" ".join(own[:35] + phrase + own[35:]))
    texts += [" ".join(sum(rng.sample(stock, 4), [])) for _ in range(60)]
    base = [f"b{i}" for i in range(200)]
    for i in range(120):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(shingles, "SAMPLE", 1)
    checked, check = [], shingles.Join.check
    monkeypatch.setattr(shingles.Join, "check", lambda self, pairs: (checked.append(pairs.distinct().count()), check(self, pairs)))
    frame = spark.createDataFrame([(i, t, "c", "d") for i, t in enumerate(texts)], "doc_id long, text string, _k string, fp string")
    for crowd in (8, 10**6):
        checked.clear()
        got = shingles.deduplicated(frame, crowd=crowd).collect()
        assert sorted(r.doc_id for r in got) == kept_of(texts)
        pairs = sum(checked)
        assert crowd > 8 or pairs < 15_000, checked


def test_stage_walks_fingerprints(spark, monkeypatch):
    """The named method, SimHash, finds near copies; what it leaves apart is searched exactly."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    far = list(base)
    for at in rng.sample(range(400), 8):
        far[at] = f"x{at}"
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(far), "nothing like these at all"]
    budgets, found, links, check = [], [], shingles.simhash.links, shingles.Join.check

    def walked(fps, budget):
        budgets.append((fps.count(), budget))
        return links(fps, budget)

    monkeypatch.setattr(shingles.simhash, "links", walked)
    monkeypatch.setattr(shingles.Join, "check", lambda self, pairs: (check(self, pairs), found.append(self.links.count())))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()) == kept_of(texts) == [0, 3]
    assert budgets[0][1] == shingles.BUDGET and budgets[0][0] >= 3 and found[0] >= 1


def test_parities_rule_out_no_link():
    rng = random.Random(4)
    for n in (0, 1, 63, 64, 65, 700):
        a = [rng.getrandbits(64) for _ in range(n)]
        b = a[: n - n // 5] + [rng.getrandbits(64) for _ in range(rng.choice([0, n // 3, 2 * n]))]
        x, y = (shingles.parities(shingles.np.unique(shingles.np.array(s, shingles.np.uint64))) for s in (a, b))
        assert shingles.least_apart(x, y) == shingles.least_apart(y, x) <= len(set(a) ^ set(b))
    rest = [shingles.parities(shingles.np.array([rng.getrandbits(64) for _ in range(500)], shingles.np.uint64)) for _ in range(2)]
    assert shingles.least_apart(*rest) > 2 * 500 / 9


def phrased(n, every, seed=6):
    """`n` texts, a phrase in every `every`th, and a near copy of each tenth."""
    rng = random.Random(seed)
    phrase, texts = [f"p{i}" for i in range(40)], []
    for i in range(n):
        own = [f"w{rng.randint(0, 50_000)}" for _ in range(50)]
        texts.append(" ".join(own[:25] + phrase * (i % every == 0) + own[25:]))
        if i % 10 == 0:
            texts.append(texts[-1] + " end")
    return texts, " ".join(phrase)


def test_sample_grows_with_the_texts(spark, monkeypatch):
    """What is common in few of many texts is known: the sample is a share of them, not a number."""
    texts, phrase = phrased(300, 8)
    monkeypatch.setattr(shingles, "SAMPLE", 10)
    monkeypatch.setattr(shingles, "OF", 20, raising=False)
    known, make = [], shingles.common_members
    monkeypatch.setattr(shingles, "common_members", lambda *args: (known.append(make(*args)), known[-1])[1])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.deduplicated(frame).collect()) == kept_of(texts)
    members, counts = known[0]
    assert set(shingles.shingle_hashes(phrase, 5).tolist()) <= set(members.tolist())
    assert len(members) == len(counts) and (counts >= 3).all() and (members[1:] > members[:-1]).all()


def test_orders_from_counts_that_are_cut(spark, monkeypatch):
    """Counts of a sample of the crowded sets, and of the most common members only, lose no link."""
    texts, _ = phrased(160, 2)
    monkeypatch.setattr(shingles, "SAMPLE", 1)
    monkeypatch.setattr(shingles, "COMMON", 40)
    monkeypatch.setattr(shingles, "COUNTED", 0.2, raising=False)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.deduplicated(frame, crowd=4).collect()) == kept_of(texts)
