"""Token files: exact round trip against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binflow.llm import common, tokens

PATH = tokens.default_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeinrst '.\nÉİǅ\xa0́<|>0²", max_size=200)))
def test_any_text(text):
    if not hasattr(test_any_text, "t"):
        from tokenizers import Tokenizer

        test_any_text.t = Tokenizer.from_file(PATH)
    got = np.frombuffer(tokens.words(PATH, "<u2").encode(text), "<u2").tolist()
    assert got == test_any_text.t.encode(text, add_special_tokens=False).ids


def test_files(spark, library):
    texts = ["", None, "Hello  World", "don't <|endoftext|> stop", "日本語", "x " * 5000, "same", "same"]
    rows = [(3 * i % 17 - 4, texts[i % len(texts)], 1) for i in range(40)] + [(None, "no id", 2), (2**40, "far", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    folder = common.shared_folder(spark)
    manifest = tokens.write(tokens.encode(docs, PATH, 2, "<u2"), folder, "<u2")
    got = tokens.read(spark, folder, manifest, "<u2").collect()
    coded = [(common.LEAST if i is None else i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u2").tobytes()) for i, t, _ in rows]
    want, start = [], 0
    for i, b in sorted(coded):
        ids = np.frombuffer(b, "<u2")
        want.append((None if i == common.LEAST else i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert sum(m[2] for m in manifest) == len(rows) and len(manifest) > 1


def test_empty(spark):
    folder = common.shared_folder(spark)
    manifest = tokens.write(tokens.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, 2, "<u2"), folder, "<u2")
    assert manifest == [] and tokens.read(spark, folder, manifest, "<u2").count() == 0


def test_with_next(spark):
    rows = [(i * 7 % 101 - 20, f"t{i}") for i in range(101)] + [(5, "a"), (5, "zz"), (None, "n"), (2**63 - 1, "max"), (-(2**63) + 1, "min")]
    got = common.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["doc_id", "text"], 16).collect()
    line = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1]))
    want = {(a, b) for a, b in zip(line, line[1:] + line[:1], strict=True)}
    assert {((r.doc_id, r.text), (r.next_doc_id, r.next_text)) for r in got} == want and len(got) == len(rows)
    one = common.with_next(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "doc_id", ["text"]).collect()
    assert [(r.doc_id, r.next_text) for r in one] == [(1, "x")]
    assert common.with_next(spark.createDataFrame([], "doc_id long, text string"), "doc_id", ["text"]).collect() == []
