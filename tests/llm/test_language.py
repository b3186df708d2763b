"""Rank-order profiles against plain Python, and accuracy on held-out documents."""

import random
from collections import Counter

import numpy as np

from binflow.llm import language

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
        p = f"\x01{w}\x01"
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def code(g):
    return sum(ord(c) << 21 * i for i, c in enumerate(g))


TEXTS = ["the cat and the dog", "Der Hund, und die Katze!", "", None, "123 %%%", "x", "日本語 текст ÀÉ İ", "a" * 50 + " b-c d_e"]


def test_counts(monkeypatch):
    for text in TEXTS + [" ".join(random.Random(1).choices(["uno", "dos", "très", "x1y"], k=500))]:
        for block in (7, 1 << 20):
            monkeypatch.setattr(language, "BLOCK", block)
            k, c = language.grams(language.symbols(text)) if len(language.symbols(text)) else ([], [])
            assert dict(zip(map(int, k), map(int, c), strict=True)) == {code(g): n for g, n in plain_counts(text).items()}


def test_against_plain(spark):
    rng = random.Random(4)
    words = {"en": ["the", "and", "of", "cat"], "de": ["der", "und", "von", "katze"], "zz": ["xqx", "zzt"]}
    rows = [(i, " ".join(rng.choices(words[name], k=30)), name, 9) for i, name in enumerate(rng.choices(list(words), k=40))]
    rows += [(100 + i, t, None, 9) for i, t in enumerate(TEXTS)] + [(100, "dup", "en", 9), (None, "the und xqx", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    profiles = language.train(docs, length=20)
    want = {}
    for name in words:
        total = Counter()
        for _, t, own, _ in rows:
            if own == name:
                total += plain_counts(t)
        best = sorted(total.items(), key=lambda x: (-x[1], np.uint64(code(x[0])).view(np.int64)))[:20]
        want[name] = {code(g): r for r, (g, _) in enumerate(best)}
    got = {}
    for r in profiles.collect():
        got.setdefault(r.lang, {})[r.gram] = r["rank"]
    assert got == want
    for r in language.predict(docs, profiles, length=20).collect():
        counts = plain_counts(r.text)
        if not counts:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        top = sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:20]
        away = {n: sum(abs(p[code(g)] - i) if code(g) in p else 20 for i, (g, _) in enumerate(top)) for n, p in want.items()}
        best = min(sorted(away), key=away.get)
        assert r.lang_pred == best and abs(r.score - (1 - away[best] / (20 * len(top)))) < 1e-12


def test_nothing_learnt(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.predict(docs, language.train(docs)).collect()] == [("und", 0.0)]
    assert language.predict(docs.limit(0), language.train(docs)).count() == 0


def test_held_out(spark):
    got = language.op7(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
