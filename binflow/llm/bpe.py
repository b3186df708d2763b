"""Exact byte-level BPE by one pass over the prefixes of each piece of text.

For every prefix of a piece there is exactly one token that can end its encoding: the one,
among the tokens that end there, that is compatible with the last token of the prefix before
it. An automaton over the vocabulary yields the tokens that end at each byte, a test on pairs
of tokens settles compatibility, and the ids follow from the back-pointers. The work is
linear in the text, however long a piece is.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.llm.common import KEPT, Known, query, table, working

#: Pairs of tokens that a worker remembers; all are forgotten when the limit is met.
PAIRS = 300_000
#: Runs of text, and pieces that the library cut, in each generation of a worker's memory.
RUNS, PIECES = 200_000, 50_000


def byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file writes each byte: printable ones as themselves,
    the others, in ascending order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.token_bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.left, self.right, self.rank = [0] * size, [0] * size, [-1] * size
        self.merged: dict[int, int] = {}
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, t = vocab[a], vocab[b], vocab[a + b]
            self.merged.setdefault(a << 32 | b, t)
            if self.rank[t] < 0:
                self.left[t], self.right[t], self.rank[t] = a, b, r
        self.size = [0] * size
        for i, b in self.token_bytes.items():
            self.size[i] = len(b)
        #: Tokens that merging their own bytes gives; others never occur.
        made = [False] * size
        for t in sorted(self.token_bytes, key=lambda t: self.rank[t]):
            l, r = self.left[t], self.right[t]  # noqa: E741
            made[t] = self.rank[t] < 0 and self.size[t] == 1 or self.rank[t] >= 0 and made[l] and made[r] and self.compatible(l, r, self.rank[t])
        self.automaton = ahocorasick.Automaton()
        self.single = [-1] * 256
        for t, b in self.token_bytes.items():
            if made[t] and len(b) == 1:
                self.single[b[0]] = t
            if made[t] and (len(b) > 1 or not merges):
                self.automaton.add_word(b.decode("latin-1"), t)
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}
        self.pieces = Known(self._piece, PIECES)
        self.runs = Known(self._run, RUNS)
        # Texts of these characters are cut by the pattern; for all others the library cuts, as
        # its Unicode tables may be of another version.
        self.settled = regex.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ]*+")
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.uneven = regex.compile(r"\s\s|[^\S \n]")
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.letters = letters
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.decimal = [str(i) for i in range(size)]

    def compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether the two tokens stay apart when their joined bytes are merged.

        Takes the merges on both sides of the border back, latest first; if the border could
        have been merged before the one taken back last, it would have been.
        """
        merged, rank = self.merged, self.rank
        while True:
            t = merged.get(a << 32 | b)
            if t is not None and rank[t] < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                a, limit = self.right[a], ra
            elif rb >= 0:
                b, limit = self.left[b], rb + 1  # of equal merges the left one comes first
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        n, done = len(piece), 0
        # One token fits each prefix: its last byte alone, where no longer one does.
        last = [-1, *map(self.single.__getitem__, piece)]
        size, known = self.size, self.known
        for end, t in self.automaton.iter(piece.decode("latin-1")):
            if end < done:
                continue
            start = end + 1 - size[t]
            if start:
                pair = last[start] << 32 | t
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    fits = known[pair] = self.compatible(last[start], t)
                if not fits:
                    continue
            done = end + 1
            last[done] = t
        ids = []
        while n:
            ids.append(last[n])
            n -= size[last[n]]
        return ids[::-1]

    def _piece(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece.encode())).tobytes()

    def _run(self, run: str) -> bytes:
        """The ids of a run that the pattern may cut. It leaves its own pieces whole, so they are
        runs as well and nothing is remembered twice."""
        cut = self.pattern.findall(run)
        return self._piece(run) if len(cut) == 1 else b"".join(map(self.runs.__getitem__, cut))

    def _plain(self, text: str) -> list[bytes]:
        if not self.settled.fullmatch(text):
            letters = self.letters
            cut = [bytes(letters[c] for c in piece).decode() for piece, _ in self.cutter.pre_tokenize_str(text)]
            return list(map(self.pieces.__getitem__, cut))
        if self.uneven.search(text):
            cut = self.pattern.findall(text)
        else:
            # White space is single blanks and line ends only: the pattern always cuts before a
            # blank and around a line end, so what lies between can be cut by itself.
            cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return list(map(self.runs.__getitem__, cut))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; strings of special tokens in it become their ids."""
        text = text or ""
        if self.marks is None or not any(s in text for s in self.special):
            return np.frombuffer(b"".join(self._plain(text)), "<u4")
        out: list[bytes] = []
        for i, part in enumerate(self.marks.split(text)):
            if i % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out.extend(self._plain(part))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


KEPT["bpe"] = codec.cache_clear


def _mapped(docs: DataFrame, key: str, text: str, fields: list[pa.Field], schema: str, make) -> DataFrame:
    """Rows (`key`, *fields) by make(list of texts), a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("bpe")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                columns = make(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, fields, strict=True))], names=["k", *(f.name for f in fields)])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, {schema}")
    return out.withColumnRenamed("k", key)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(offsets, values)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, n_tokens, ids array<int>): every row's whole text; a null text counts as empty."""

    def make(texts):
        ids = [codec(path).encode(t) for t in texts]
        return [len(i) for i in ids], _lists(ids)

    return _mapped(docs, key, text, [pa.field("n_tokens", pa.int64()), pa.field("ids", pa.list_(pa.int32()))], "n_tokens long, ids array<int>", make)


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(`key`, text): the texts that the ids stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(ids)).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(`key`, n_tokens, ids_sha256, decoded_sha256): encoded, and decoded again from the ids;
    with `ids` also an array<int> of them.

    Nulls and empty texts give no tokens and the digests of an empty string. Repeated rows are
    repeated.
    """

    def make(texts):
        c, coded, ids_sha, text_sha = codec(path), [], [], []
        for t in texts:
            own = c.encode(t)
            coded.append(own)
            ids_sha.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, own.tolist())).encode()).hexdigest())
            text_sha.append(hashlib.sha256(c.decode(own).encode()).hexdigest())
        return [len(i) for i in coded], ids_sha, text_sha, *([_lists(coded)] if ids else [])

    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    fields += [pa.field("ids", pa.list_(pa.int32()))] if ids else []
    return _mapped(docs, key, text, fields, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids, make)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_path())
