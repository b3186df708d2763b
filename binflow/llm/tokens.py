"""Token files: flat unsigned ids with 64-bit document offsets, in ascending document order.

Documents are dealt to ranges of their id; each range becomes three files, `ids-<range>.bin`
(ids as unsigned 16-bit little-endian numbers if the vocabulary allows it, else 32-bit),
`.off` (n + 1 offsets, 64-bit, in ids from the file's start) and `.key` (n document ids,
64-bit). The prefix sum of the ranges' totals gives each file's base. A task writes under a
name of its own and renames at the end, so a repeated task replaces equal files by equal ones.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.llm.bpe import byte_letters
from binflow.llm.common import LEAST, Known, Ranges, query, shared_folder, table

#: Words in each generation of a worker's memory.
MEMORY = 700_000


class Words:
    """The ids of whole texts as the library gives them, by way of words and their pieces."""

    def __init__(self, path: str, dtype: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        self.library, self.dtype = Tokenizer.from_file(path), dtype
        # Characters on which the library's normaliser and Python's lower() agree, and which
        # no normal form changes; texts with others go to the library as a whole.
        self.settled = regex.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ]*+")
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters = {b: c for c, b in byte_letters().items()}
        merge, packed = self.library.model.tokenize, "H" if dtype == "<u2" else "I"

        def piece_ids(piece: str) -> bytes:
            written = piece if piece.isascii() else "".join(letters[b] for b in piece.encode())
            return array(packed, [t.id for t in merge(written)]).tobytes()

        self.words = Known(lambda word: b"".join(map(piece_ids, self.pattern.findall(word))), MEMORY)
        # Points and commas beside another mark; elsewhere they are pieces of their own.
        self.joined = regex.compile(r"[.,][^\s\p{L}\p{N}]|[^\s\p{L}\p{N}][.,]")

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The vocabulary drops white space and never joins across it, nor across the pieces of
        its pattern, so words are encoded by the library one by one and remembered."""
        text = text or ""
        if not self.settled.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        text = text.lower()
        if not self.joined.search(text):
            text = text.replace(".", " . ").replace(",", " , ")
        return b"".join(map(self.words.__getitem__, text.split()))


@cache
def words(path: str, dtype: str) -> Words:
    return Words(path, dtype)


def id_type(path: str, *ids: int) -> str:
    """The narrowest unsigned type that holds every id of the vocabulary and `ids`."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1, *ids) < 1 << 16 else "<u4"


def encode(docs: DataFrame, path: str, end: int, dtype: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, ids binary): each whole text's ids with `end` after them; null counts as empty."""
    tail = np.array([end], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(path, dtype)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [w.encode(t) + tail for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["k", "ids"])

    out = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return out.mapInArrow(run, "k long, ids binary").withColumnRenamed("k", key)


def _place(folder: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return fs.FileSystem.from_uri(uri)


def write(rows: DataFrame, folder: str, dtype: str, key: str = "doc_id", keys: DataFrame | None = None) -> list[tuple]:
    """Write (`key`, ids binary) as token files; the manifest (range, base, docs, ids) of
    `read`, one entry for each file, in order.

    keys: a table with the same keys, from which the ranges are taken; reading a column of the
    source saves encoding everything for its keys.
    Rows with the same key are ordered by their ids. A null key comes first and is written as
    the least 64-bit number.
    """
    width = np.dtype(dtype).itemsize
    ranges = Ranges(rows if keys is None else keys, key)
    dealt = rows.select(F.coalesce(F.col(key), F.lit(LEAST)).alias("k"), "ids", ranges.of(F.col(key)).alias("r"))
    dealt = dealt.repartition("r").sortWithinPartitions("r", "k", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        files, base = _place(folder)
        files.create_dir(base, recursive=True)
        own = f".{TaskContext.get().taskAttemptId()}"
        now, out, docs, total, done = None, {}, 0, 0, []

        def close():
            for kind, stream in out.items():
                stream.close()
                name = f"{base}/ids-{now:06d}.{kind}"
                files.move(name + own, name)
            done.append((now, docs, total))

        for batch in batches:
            range_of = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(range_of)) + 1).tolist(), len(range_of)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if range_of[lo] != now:
                    if now is not None:
                        close()
                    now, docs, total = int(range_of[lo]), 0, 0
                    out = {k: files.open_output_stream(f"{base}/ids-{now:06d}.{k}{own}") for k in ("bin", "off", "key")}
                    out["off"].write(np.zeros(1, "<i8").tobytes())
                ids = batch.column(1).slice(lo, hi - lo).to_pylist()
                ends = total + np.cumsum([len(i) // width for i in ids])
                out["bin"].write(b"".join(ids))
                out["off"].write(ends.astype("<i8").tobytes())
                out["key"].write(batch.column(0).slice(lo, hi - lo).to_numpy().astype("<i8").tobytes())
                docs, total = docs + len(ids), int(ends[-1])
        if now is not None:
            close()
        yield pa.RecordBatch.from_pydict({"r": [d[0] for d in done], "docs": [d[1] for d in done], "ids": [d[2] for d in done]}, schema=pa.schema([("r", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))

    # One row for each file, as many as there are ranges.
    made = sorted(map(tuple, dealt.mapInArrow(run, "r int, docs long, ids long").collect()))
    bases = accumulate((m[2] for m in made), initial=0)
    return [(r, base, docs, ids) for (r, docs, ids), base in zip(made, bases, strict=False)]


def read(spark: SparkSession, folder: str, manifest: list[tuple], dtype: str, key: str = "doc_id") -> DataFrame:
    """(`key`, start, n_tokens, ids_crc32) of every document, from the files.

    A local or mounted folder is memory-mapped; elsewhere a file is read in pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = _place(folder)
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for r, first, docs in zip(batch["r"], batch["base"], batch["docs"], strict=True):
                name = f"{base}/ids-{r:06d}"
                if isinstance(files, fs.LocalFileSystem):
                    off, keys = np.memmap(f"{name}.off", "<i8", "r"), np.memmap(f"{name}.key", "<i8", "r")
                    flat = np.memmap(f"{name}.bin", dtype, "r") if off[-1] else np.empty(0, dtype)
                    cut = lambda a, b: flat[a:b]  # noqa: B023, E731
                else:
                    off, keys = (np.frombuffer(files.open_input_stream(f"{name}.{k}").readall(), "<i8") for k in ("off", "key"))
                    stream = files.open_input_file(f"{name}.bin")
                    cut = lambda a, b: np.frombuffer(stream.read_at((b - a) * width, a * width), dtype)  # noqa: B023, E731
                for at in range(0, docs, 10_000):
                    spans = off[at : min(docs, at + 10_000) + 1].tolist()
                    sums = [zlib.crc32(cut(a, b).astype("<u4").tobytes()) for a, b in zip(spans, spans[1:], strict=False)]
                    yield pd.DataFrame({"k": keys[at : at + 10_000], "start": first + np.array(spans[:-1]), "n": np.diff(spans), "crc": sums})

    listed = spark.createDataFrame(manifest, "r int, base long, docs long, ids long").repartition(max(1, len(manifest)))
    out = listed.mapInPandas(run, "k long, start long, n long, crc long")
    return out.select(F.nullif("k", F.lit(LEAST)).alias(key), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    dtype, folder = id_type(default_path(), 2), shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    manifest = write(encode(docs, default_path(), 2, dtype), folder, dtype, keys=docs)
    return read(spark, folder, manifest, dtype)
