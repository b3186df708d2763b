"""The prefix encoder against the tokenizers library."""

import hashlib
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binflow.llm import bpe

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


TEXTS = [
    "", " ", "\n\n\t x", "Hello world, it's 2024!", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "naïve café ÀÉß", "日本語 テスト 😀😀 é", "á e\x1c\x85\xa0z",
    "<|endoftext|>", "x <|endoftext|><|endoftext|> y", "<|endoftext|", "=" * 500, "ab" * 3000, "the " * 4000, "\x00\x01퟿�", "   lead  and  trail   ", "don't I'LL we've", "ࡰᲉ ǆ ½ ² ٣",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_text(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = bpe.codec(PATH).encode(text)
    assert got.tolist() == want
    assert bpe.codec(PATH).decode(got) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("aeinrst '.\n<|>éü0", max_size=200)))
def test_any_text(text):
    from tokenizers import Tokenizer

    if not hasattr(test_any_text, "t"):
        test_any_text.t = Tokenizer.from_file(PATH)
    want = test_any_text.t.encode(text, add_special_tokens=False).ids
    got = bpe.codec(PATH).encode(text)
    assert got.tolist() == want
    assert bpe.codec(PATH).decode(got) == test_any_text.t.decode(want, skip_special_tokens=False)


def test_forgets(library, monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 5)
    monkeypatch.setattr(bpe, "RUNS", 5)
    monkeypatch.setattr(bpe, "PIECES", 5)
    c = bpe.Codec(PATH)
    text = " ".join(f"word{i} thing{i % 3}" for i in range(50))
    assert c.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(len(c.pieces), len(c.pieces.older), len(c.known)) <= 5


def test_memory_of_a_worker(library):
    """What a worker remembers of texts stays under 100 MB, of short words and of long ones."""
    c = bpe.Codec(PATH)
    text = "a word, a second word (and more)"
    assert c.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert not any(p in c.runs for p in c.pieces)
    for make, width in ((lambda key: bytes(16), 9), (lambda key: bytes(256), 60)):
        for memory in (c.runs, c.pieces):
            memory.clear()
            memory.make = make
            for i in range(2 * memory.size + 2):
                memory[f"{i:0{width}d}"]
        parts = [part for memory in (c.runs, c.pieces) for part in (memory, memory.older)]
        assert sum(sys.getsizeof(part) + sum(sys.getsizeof(x) for pair in part.items() for x in pair) for part in parts) < 100e6


def test_bytes_without_longer_tokens(tmp_path):
    """A vocabulary of bytes alone, and one of bytes and a single merge."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = bpe.byte_letters()
    for merges in ([], [("a", "b")]):
        vocab = letters | {x + y: 256 for x, y in merges}
        t = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        t.save(path := str(tmp_path / f"{len(merges)}.json"))
        for text in ("", "abba é, ab", "日本"):
            assert bpe.Codec(path).encode(text).tolist() == t.encode(text).ids


def test_frames(spark, library):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS[:-4] + TEXTS[-3:])] + [(90, None, None), (90, None, None), (None, "tie", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, bpe.round_trip(docs, PATH).collect()))) == sorted(map(str, want))
    encoded = bpe.encode(docs, PATH)
    assert {r.n_tokens == len(r.ids) for r in encoded.collect()} == {True}
    back = {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()}
    assert all(back[i] == (t or "") for i, t, _ in rows)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_lists():
    out = bpe._lists([np.array([1, 2]), np.array([], np.int64)])
    assert out.to_pylist() == [[1, 2], []]
