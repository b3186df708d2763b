"""The whole pipeline against a brute-force version over the smallest tables."""

import hashlib
import math
import re
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_decontaminate import any_stretch, tokens  # noqa: E402
from test_language import code, plain_counts  # noqa: E402
from test_shingles import alike, shingle_set  # noqa: E402
from test_simhash import plain_components  # noqa: E402

from binflow.llm import bpe, decontaminate, language, secrets, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def kept_languages(docs):
    total = {}
    counts = {i: plain_counts(t) for i, t, _ in docs}
    for i, _, lang in docs:
        if lang is not None:
            total.setdefault(lang, Counter()).update(counts[i])
    order = lambda c: sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[: language.LENGTH]
    profiles = {n: {g: r for r, (g, _) in enumerate(order(c))} for n, c in total.items()}
    out = []
    for d in docs:
        top = order(counts[d[0]])
        if not top:
            continue
        away = min(sum(abs(p[g] - r) if g in p else language.LENGTH for r, (g, _) in enumerate(top)) for p in profiles.values())
        if 1 - away / (language.LENGTH * len(top)) >= language.LEAST_SCORE:
            out.append(d)
    return out


def kept_first(docs):
    sets = {i: shingle_set(t) for i, t, _ in docs}
    edges = [(a, b) for a, b in combinations(sorted(sets), 2) if alike(sets[a], sets[b])]
    least = plain_components(sorted(sets), edges)
    return [d for d in docs if least[d[0]] == d[0]]


def leaks(text, items):
    own = tokens(text)
    for item in items:
        places = {}
        for k in range(len(item) - 2):
            places.setdefault(tuple(item[k : k + 3]), []).append(k)
        shifts = {i - k for i in range(len(own) - 2) for k in places.get(tuple(own[i : i + 3]), ())}
        for s in shifts:
            equal = [own[k + s] == item[k] for k in range(max(0, -s), min(len(item), len(own) - s))]
            least = min(decontaminate.LEAST_TOKENS, math.ceil(0.8 * len(item) - 1e-9))
            if len(item) < decontaminate.SPAN and sum(equal) == len(item) >= decontaminate.SHORTEST_ITEM:
                return True
            if len(item) >= decontaminate.SPAN and sum(equal) >= 5 and any_stretch(equal, least):
                return True
    return False


@pytest.mark.skipif(not Path(SF).exists(), reason="benchmark tables not present")
def test_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    items = [tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [d for d in kept_first(kept_languages(docs)) if not leaks(d[1], items)]
    assert 50 < len(left) < len(docs)
    library = Tokenizer.from_file(bpe.default_path())
    want = {}
    for i, t, _ in left:
        t = re.sub(r'(?<=token = ")[0-9a-f]{40}(?=")', secrets.MASK, t)
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing columns, an empty table."""
    text = " ".join(f"wort{i % 40} und die" for i in range(60))
    rows = [(1, text, "de", "s", 5, "x"), (1, text, "de", "s", 5, "x"), (2, text, None, None, None, None), (None, text, "de", None, None, "x"), (3, None, None, None, None, "x"), (4, "", "de", "s", 0, "x"), (5, "12 34 %", "de", "s", 7, "x"), (None, "allein und die " * 9, "de", None, None, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component string"
    spark.createDataFrame([(0, "nothing to see here at all in this item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        count, docs = frame.count(), frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "bpe":
                assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        kept = sorted(str(r.doc_id) for r in docs.collect())
        assert kept == (["1", "None"] if count else [])


def test_deduplicated_rows(spark):
    near = " ".join(f"w{i}" for i in range(300))
    rows = [(1, near), (1, near + " end"), (2, near), (7, "other text of its own"), (7, "another text with the same id"), (None, near), (None, None), (9, "")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    got = sorted(str(tuple(r)) for r in simhash.deduplicated(frame).collect())
    one = min(near, near + " end")
    assert got == sorted(str(r) for r in [(1, one, "c"), (7, rows[3][1], "c"), (7, rows[4][1], "c"), (9, "", "c")])


def test_masked_lengths(spark):
    rows = [(1, 'x token = "' + "a1b2c3d4e5" * 4 + '" y', "de", "s", 99)]
    out = corpus_pipeline.mask_secrets(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).first()
    assert out.text == f'x token = "{secrets.MASK}" y' and out.n_chars == len(out.text)
