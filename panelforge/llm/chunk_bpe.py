"""Byte-level BPE over overlapping chunks.

A long text is cut into chunks that overlap by ``overlap`` code points; each
chunk is a row of its own, so the chunks of one text run in many tasks.  Every
chunk is pre-tokenised on its own.  The pre-token pattern has no
look-behind, so two scans that share one boundary agree from there on: two
neighbouring chunks are stitched at the first boundary both of them have in
their overlap (boundaries near a chunk's end are not trusted, because the
pattern may look up to three characters ahead).  The text between two
stitches is a piece; pieces are encoded across tasks, and the ids and bytes of a text are
put together in the order of its pieces.  Where an overlap holds no common boundary (one giant
pre-token), the chunks on both sides become one and are scanned again, until
every border has a stitch; no text is cut blindly.  A text of one
chunk is a piece as it is and is encoded where it lies.

Only borders (at most ``overlap`` numbers a chunk) meet by text: the texts
of chunks are dealt by (text, chunk).  A Spark string has less than 2^31 bytes, which bounds
the chunks of a text; a task holds whole texts only to cut them and to put ids together.

NULL and empty texts give no ids; repeated rows give repeated results; only
the key column is carried along.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import BATCH_BYTES, by_bytes, scratch_table, slim

CHUNK, OVERLAP = 16_384, 256
#: Characters from its start by which the pattern has chosen a pre-token's kind.
AHEAD = 3


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str, special: tuple = ()) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


@lru_cache(maxsize=4)
def token_bytes(path: str, pattern: str) -> list[bytes]:
    enc = encoding(path, pattern)
    return [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]


@lru_cache(maxsize=4)
def _compiled(pattern: str):
    return regex.compile(pattern)


def trusted_ends(text: str, final: bool, pattern: str) -> list[int]:
    """Ends of the pre-tokens of ``text`` that do not depend on what follows it (nothing does, if ``final``)."""
    at, ends, stop = 0, [], len(text)
    for token in _compiled(pattern).findall(text):
        begin, at = at, at + len(token)
        if final or at < stop and begin + AHEAD <= stop:
            ends.append(at)
    return ends


def boundaries(text: str, start: int, stop: int, pattern: str) -> list[int]:
    """Trusted ends of the pre-tokens of text[start:stop], as places in ``text``."""
    return [start + x for x in trusted_ends(text[start:stop], stop == len(text), pattern)]


def stitches(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Cuts at which separate encoding of the pieces equals encoding the text."""
    n = len(text)
    if n <= chunk + overlap:
        return [0, n]
    cuts, start, stop, c = [0], 0, chunk + overlap, 0
    own = boundaries(text, start, stop, pattern)
    while stop < n:
        c = max(c + 1, (stop - overlap) // chunk)
        a = c * chunk
        b = min(n, a + chunk + overlap)
        theirs = boundaries(text, a, b, pattern)
        known = set(theirs)
        known.add(a)
        # a piece must not end in white space: its last run could match differently
        p = next((x for x in own[bisect_left(own, a):] if x in known and x > cuts[-1] and not text[x - 1].isspace()), None)
        if p is None:
            begin = cuts[-1]
            stop = min(n, begin + 2 * (stop - begin))
            own = boundaries(text, begin, stop, pattern)
            continue
        cuts.append(p)
        own, stop = [x for x in theirs if x > p], b
    return [*cuts, n]


def encode(text: str, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    enc = encoding(path, pattern)
    cuts = stitches(text, pattern, chunk, overlap)
    parts = [np.asarray(enc.encode_ordinary(text[a:b]), dtype="<u4") for a, b in zip(cuts, cuts[1:])]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    return b"".join(map(token_bytes(path, pattern).__getitem__, ids.tolist()))


def cut(src: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The chunks of every text: ``row``, ``key``, ``c`` and ``upto`` (first and last
    of the chunks it stands for, here the same), ``final`` (the text ends in it), ``text``."""
    schema = T.StructType([T.StructField("row", T.LongType()), src.schema["key"], *(T.StructField(x, T.IntegerType()) for x in ("c", "upto")),
                           T.StructField("final", T.BooleanType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, final, texts, held = [], [], [], [], 0

            def out(batch=batch):
                c = pa.array(numbers, pa.int32())
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), c, c, pa.array(final), pa.array(texts)], schema.names)

            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                n = max(1, -((overlap - len(text)) // chunk))
                for c in range(n):
                    at.append(i)
                    numbers.append(c)
                    final.append(c == n - 1)
                    texts.append(text[c * chunk:(c + 1) * chunk + overlap])
                    held += len(texts[-1])
                    if held > BATCH_BYTES:
                        yield out()
                        at, numbers, final, texts, held = [], [], [], [], 0
            if at:
                yield out()

    return src.select(F.monotonically_increasing_id().alias("row"), "key", "text").mapInArrow(run, schema)


def borders(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Every chunk's boundaries in its two overlaps, counted from the start of each: ``head``, ``tail``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for c, upto, final, text in zip(*(batch.column(i) for i in range(1, 5))):
                text, width = text.as_py(), (upto.as_py() - c.as_py() + 1) * chunk
                ends = trusted_ends(text, final.as_py(), pattern)
                heads.append([0, *ends[:bisect_right(ends, overlap)]])
                # a piece must not end in white space: its last run could match differently
                tails.append([x - width for x in ends[bisect_left(ends, width):] if not text[x - 1].isspace()])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *lists], ["row", "c", "upto", "final", "head", "tail"])

    return chunks.select("row", "c", "upto", "final", "text").mapInArrow(run, "row long, c int, upto int, final boolean, head array<int>, tail array<int>")


def stitched(met: DataFrame) -> DataFrame:
    """``at``, the stitch with the next chunk (NULL: none), and ``begin``, that with the chunk before."""
    order = Window.partitionBy("row").orderBy("c")
    met = met.withColumn("at", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    return met.select("row", "c", "upto", "final", "at", F.lag("at").over(order).alias("begin"))


def merged(chunks: DataFrame, runs: DataFrame, chunk: int) -> DataFrame:
    """One chunk for every run (``row``, ``first``) of chunks."""
    def own(x: Column) -> Column:
        return F.when(x["upto"] == F.col("upto"), x["text"]).otherwise(F.substring(x["text"], F.lit(1), (x["upto"] - x["c"] + 1) * chunk))

    parts = chunks.join(runs, ["row", "c"]).groupBy("row", F.col("first").alias("c")).agg(
        F.first("key").alias("key"), F.max("upto").alias("upto"), F.max("final").alias("final"), F.array_sort(F.collect_list(F.struct("c", "upto", "text"))).alias("parts"))
    return parts.select("row", "key", "c", "upto", "final", F.array_join(F.transform("parts", own), "").alias("text"))


def pieces(src: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``row``, ``key``, ``c``, ``begin``, ``stop``, ``text``: a text is text[begin:stop] of its chunks, by ``c``."""
    chunks = scratch_table(cut(src, chunk, overlap).repartition("row", "c"), "chunks")
    met = scratch_table(borders(chunks, pattern, chunk, overlap), "borders")
    while True:
        found = stitched(met)
        # chunks without a stitch between them, named by the first
        first = F.max(F.when((F.col("c") == 0) | F.col("begin").isNotNull(), F.col("c"))).over(Window.partitionBy("row").orderBy("c"))
        runs = found.withColumn("first", first).withColumn("members", F.count("*").over(Window.partitionBy("row", "first"))).filter("members > 1")
        runs = scratch_table(runs.select("row", "c", "first"), "runs")
        if runs.isEmpty():
            break
        whole = scratch_table(merged(chunks, runs, chunk), "merged")
        chunks = chunks.join(runs, ["row", "c"], "left_anti").unionByName(whole)
        met = scratch_table(met.join(runs, ["row", "c"], "left_anti").unionByName(borders(whole, pattern, chunk, overlap)), "borders")
    stop = F.when(~F.col("final"), (F.col("upto") - F.col("c") + 1) * chunk + F.col("at"))
    return chunks.select("row", "key", "c", "text").join(found.select("row", "c", F.coalesce("begin", F.lit(0)).alias("begin"), stop.alias("stop")), ["row", "c"])


def encode_documents(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str,
                     chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: ``key``, ``ids`` (little-endian unsigned 32-bit),
    ``decoded`` (the bytes that the ids decode to).  Pieces of long texts are found
    at once, in tables in the shared folder; ``chunk`` must exceed ``overlap``."""
    if not 0 < overlap < chunk:
        raise ValueError(f"overlap must be positive and less than chunk, not {overlap} of {chunk}")
    src = slim(df, key=id_col, text=F.coalesce(df[text_col], F.lit("")))
    key = src.schema["key"]
    coded = [T.StructField("ids", T.BinaryType(), False), T.StructField("decoded", T.BinaryType(), False)]
    one_chunk = F.char_length("text") <= chunk + overlap

    def encoded(texts: list[str]) -> list[pa.Array]:
        enc = encoding(path, pattern)
        ids = [np.asarray(enc.encode_ordinary(x), dtype="<u4") for x in texts]
        return [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([decode(x, path, pattern) for x in ids], pa.binary())]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), *encoded(part.column(1).to_pylist())], ["key", "ids", "decoded"])

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 5):
                got = [x.as_py()[a:b] for a, b, x in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *encoded(got)], ["row", "key", "c", "ids", "decoded"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([b"".join(batch.column(j)[i].as_py())], pa.binary()) for j in (1, 2))], ["key", "ids", "decoded"])

    short = src.filter(one_chunk).mapInArrow(texts, T.StructType([key, *coded]))
    parts = pieces(src.filter(~one_chunk), pattern, chunk, overlap).select("row", "key", "c", "begin", "stop", "text")
    parts = parts.mapInArrow(cuts, T.StructType([T.StructField("row", T.LongType()), key, T.StructField("c", T.IntegerType()), *coded]))
    parts = parts.groupBy("row").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct("c", "ids", "decoded"))).alias("parts"))
    whole = parts.select("key", F.col("parts.ids").alias("ids"), F.col("parts.decoded").alias("decoded")).mapInArrow(joined, T.StructType([key, *coded]))
    return short.unionByName(whole)
