"""Secret scans: candidates, features, the forest on held-out findings, masking."""

import random
import re

import pytest
from pyspark.sql import functions as F

from binflow.llm import secrets

SF = "/root/testdata/sf0.01"


def hexed(rng, n=40):
    while True:
        v = "".join(rng.choices("0123456789abcdef", k=n))
        if re.search("[a-f]", v) and re.search("[0-9]", v):
            return v


def corpus(rng, n=120):
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "paper"]
    docs, planted = [], {}
    for i in range(n):
        parts = rng.choices(words, k=30)
        if i % 3 == 0:
            planted[i] = v = hexed(rng)
            parts.insert(rng.randrange(30), f'token = "{v}"')
        if i % 4 == 0:
            parts.insert(rng.randrange(30), "".join(rng.choices("0123456789", k=16)))
        if i % 5 == 0:
            parts.insert(rng.randrange(30), "riverstonecloudpaper7")
        docs.append((i, " ".join(parts), "src/app.py", "c"))
    return docs, planted


FIELDS = "doc_id long, text string, source string, value string"


def test_candidates(spark):
    texts = [None, "", "nothing here", 'key="a b" pass: \'longvalue\' x="short"', "a1" * 20 + " mid " + "b2" * 9 + "==", "x" * 5000 + " " + "9" * 16, "1234567890123456é", "a" * 300 + "1"]
    rows = [(i, t, None, "c") for i, t in enumerate(texts)]
    got = sorted((r.doc_id, r.n, r.start, r.value) for r in secrets.candidates(spark.createDataFrame(rows, FIELDS)).collect())
    assert got == [(3, 0, 17, "longvalue"), (4, 0, 0, "a1" * 20), (4, 1, 45, "b2" * 9 + "=="), (5, 0, 5001, "9" * 16), (6, 0, 0, "1234567890123456"), (7, 0, 0, "a" * 300 + "1")]


@pytest.fixture(scope="module")
def scanned(spark):
    docs, planted = corpus(random.Random(1))
    docs += [(0, docs[0][1], "src/app.py", "c"), (500, None, None, "c"), (None, f'token = "{hexed(random.Random(9))}"', None, "c"), (501, "", "x", None)]
    frame = spark.createDataFrame(docs, FIELDS)
    return frame, docs, planted, secrets.scan(frame)


def test_scan_and_mask(scanned):
    frame, docs, planted, found = scanned
    rows = found.collect()
    assert {(r.doc_id, r.value) for r in rows if r.is_secret and r.doc_id is not None} == set(planted.items())
    assert all(0 <= r.score <= 1 for r in rows) and any(not r.is_secret for r in rows)
    out = secrets.masked(frame, found)
    assert out.columns == frame.columns
    want = sorted(str((i, t if t is None else re.sub(r'(?<=token = ")[0-9a-f]{40}', secrets.MASK, t), s, v)) for i, t, s, v in docs)
    assert sorted(str(tuple(r)) for r in out.collect()) == want


def test_forest_on_labelled_findings(spark):
    """Labels that the text's own rules know nothing of: base64 values in deploy files are secrets,
    those in test files are not."""
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = []
    for i in range(400):
        v = "".join(rng.choices(letters, k=32)) + "7"
        rows.append((i, f"send {v} now", "deploy/prod.yaml" if i % 2 else "tests/data.txt", v, float(i % 2)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, value string, label double")
    learn = frame.where("doc_id < 250").select("value", F.lit("send ").alias("before"), F.lit(" now").alias("after"), F.col("source").alias("path"), "label")
    got = secrets.scan(frame.where("doc_id >= 250"), labelled=learn).collect()
    assert len(got) == 150 and sum(r.is_secret == (r.doc_id % 2 == 1) for r in got) >= 145


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "card 1234567812345678 x", None, ""), (2, "id zx81qwertyuiopas9d2f3", None, "")], FIELDS)
    assert {(r.doc_id, r.is_secret) for r in secrets.scan(docs).collect()} == {(1, False), (2, True)}
    none = docs.limit(0)
    assert secrets.scan(none).count() == 0 and secrets.masked(none, secrets.scan(none)).count() == 0


def test_documents(spark):
    got = secrets.op1(spark, SF)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = {(i, m.start(1)) for i, t in text.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")}
    rows = got.collect()
    assert {(r.doc_id, r.start) for r in rows if r.is_secret} == want
