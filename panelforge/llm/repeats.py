"""Removal of byte strings that occur more than once (exact substring dedup).

A byte goes if a string of ``length`` bytes that covers it also starts
anywhere else, in the same or another text.  The repeated intervals are found
by refining blocks of equal strings, from short to long, and only what still
shares its block is looked at again:

1. Anchors: of every ``length - GRAM + 1`` neighbouring ``GRAM``-byte strings
   the one of least hash is an anchor (ties all are).  A window of ``length``
   bytes belongs to the leftmost least gram in it, so equal windows belong to
   equal grams, at the same place.
2. An anchor whose gram occurs once has no repeated window.  If the whole
   stretch of an anchor's windows occurs again, all of them are repeated.
3. What is left (a repeated gram in differing surroundings) is refined, beside
   one anchor of every whole stretch with that gram: its windows in slices of
   ``SLICE``, by the bytes that all windows of a slice share, and by all bytes
   they cover; then, in the same way, each window of a slice that has company
   but does not occur again as a whole.

Blocks are named by 64-bit digests, so that a step is a grouped count with
map-side partial sums and a join back: no task needs all strings of a block.
Tasks resolve what repeats among their own texts before the shuffle, so a
passage that every text has costs two rows a task.

NULL texts count as empty; texts of under ``length`` bytes keep all bytes;
equal texts repeat each other.  Only the key column is carried along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import BATCH_BYTES, handed_on, scratch_table, with_row

LENGTH, GRAM, SLICE = 200, 32, 24
#: Anchors that a task holds before it resolves them among themselves.
HELD_ANCHORS = 1 << 19
#: Texts are digested together up to so many bytes, few enough for a core's cache.
CHUNK_BYTES = 1 << 14
SIZE_MASK, KNOWN = 0x7FFF, 0x8000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(17).integers(1, 1 << 63, 256, np.uint64)
_MIX = np.uint64(0xC4CEB9FE1A85EC53)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2^64, up to n."""
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Digests:
    """Digests of the substrings of one byte string; they depend on the bytes alone, not on the place."""

    def __init__(self, raw: bytes | np.ndarray):
        up, self.down = powers(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        terms = _BYTES.take(np.frombuffer(raw, np.uint8))
        terms *= up[:len(raw)]
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        found = self.sums[size:] - self.sums[:n]
        found *= self.down[:n]
        return _mix(found)


def least_ahead(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by those of 2, 4, 8 ... neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and where each starts and the last ends.  NULLs are empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    raw = np.zeros(0, np.uint8) if held is None else np.frombuffer(held, np.uint8)
    return raw[edges[0]:edges[-1]], edges - edges[0]


def chunks(edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of values, each closed once it holds ``CHUNK_BYTES``."""
    cuts = [0, *(np.flatnonzero(np.diff(edges[1:] // CHUNK_BYTES)) + 1).tolist(), len(edges) - 1]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def owned(raw: np.ndarray, edges: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each anchor with windows, in texts that lie one after the other: its text's
    number, its gram, the digest of the stretch of its windows, its position in its
    text, and how far before it the last and the first of them start.  Grams are
    compared by their upper 32 bits, which leaves the lower ones for the position."""
    n_windows = len(raw) - length + 1
    if n_windows < 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    digests = Digests(raw)
    grams = digests.grams(gram)
    keys = grams & np.uint64(0xFFFFFFFF00000000)
    keys |= np.arange(len(grams), dtype=np.uint64)
    least = least_ahead(keys, length - gram + 1)  # differs where the anchor does
    sizes = np.diff(edges)
    ends = edges[:-1] + np.maximum(sizes - length + 1, 0)  # the next windows would reach into the next text
    borders = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, edges[:-1], ends, [n_windows]]))
    first, last = borders[:-1], borders[1:] - 1
    text = np.searchsorted(edges, first, "right") - 1
    some = (first < n_windows) & (first < ends[np.minimum(text, len(ends) - 1)])
    first, last, text = first[some], last[some], text[some]
    at = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return text, grams[at], digests.of(first, last + length), at - edges[text], at - last, at - first


def _pack(at: np.ndarray, near: np.ndarray, far: np.ndarray, n_bytes: int) -> np.ndarray:
    """Position, window range and 15 bits of the text's size in one number (a bit is left for ``KNOWN``)."""
    return (at << 32) | (near << 24) | (far << 16) | (n_bytes & SIZE_MASK)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 32, (packed >> 24) & 0xFF, (packed >> 16) & 0xFF


def repeated_spans(src: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``th``, ``nb`` (hash and low size bits of a text) and ``ranges``: packed
    (first byte << 32 | byte after the last) of its repeated stretches, unordered.
    ``src`` has th, nb and text."""
    if not gram < length <= gram + 224:
        raise ValueError("length must be above the gram's and at most 224 more")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            g, c, th, packed = (np.concatenate([x[k] for x in held]) for k in range(4))
            order = np.lexsort((c, g))
            g, c, th, packed = g[order], c[order], th[order], packed[order]
            n = np.arange(len(g))
            starts = np.maximum.accumulate(np.where(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]), n, 0))
            known = n - starts >= 2  # the first two of a block stand for it elsewhere
            g = np.where(known, _mix(th.view(np.uint64) ^ packed.view(np.uint64)), g)
            packed = np.where(known, packed | KNOWN, packed)
            for a in range(0, len(g), 50_000):
                s = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(g[s].view(np.int64)), pa.array(c[s].view(np.int64)), pa.array(th[s]), pa.array(packed[s])], ["g", "c", "th", "packed"])

        for batch in batches:
            ths, nbs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            raw, edges = flat(batch.column(2))
            for a, b in chunks(edges):
                text, g, c, at, near, far = owned(raw[edges[a]:edges[b]], edges[a:b + 1] - edges[a], length, gram)
                if len(g):
                    held.append((g, c, ths[a:b][text], _pack(at, near, far, nbs[a:b][text])))
                    size += len(g)
                if size >= HELD_ANCHORS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    found = src.select("th", "nb", "text").mapInArrow(parse, "g long, c long, th long, packed long")
    known = F.col("packed").bitwiseAND(F.lit(KNOWN)) != 0
    company = found.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    found = found.join(company, "g", "left").filter(known | F.col("n").isNotNull()).drop("n")
    again = found.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1")
    rows = found.join(again, "c", "left").select("g", "c", "th", "packed", known.alias("known"), (known | F.col("n").isNotNull()).alias("whole"))
    rows = scratch_table(rows.withColumn("nb", F.col("packed").bitwiseAND(F.lit(SIZE_MASK)).cast("int")), "blocks")
    # unresolved anchors, and one anchor of each whole block that may share windows with them
    unresolved = rows.filter("not whole")
    standing = rows.filter("whole and not known").join(unresolved.select("g").distinct(), "g", "left_semi")
    standing = standing.withColumn("turn", F.row_number().over(Window.partitionBy("g", "c").orderBy("th", "packed"))).filter("turn = 1").drop("turn")
    wanted = unresolved.unionByName(standing).groupBy("th", "nb").agg(F.collect_set("packed").alias("packed"))

    stretch = pa.schema([("th", pa.int64()), ("nb", pa.int32()), ("packed", pa.int64()), ("raw", pa.binary())])

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretch of each wanted anchor's windows."""
        for batch in batches:
            out: list[list] = [[], [], [], []]
            held = 0
            for th, nb, text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                for packed, at, near, far in zip(listed, *(x.tolist() for x in _unpack(np.array(listed, np.int64)))):
                    for column, value in zip(out, (th, nb, packed, raw[at - far:at - near + length])):
                        column.append(value)
                    held += length + far
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, stretch.types)], schema=stretch)
                    out, held = [[], [], [], []], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, stretch.types)], schema=stretch)

    texts = src.select("th", "nb", "text").join(wanted, ["th", "nb"]).select("th", "nb", "text", "packed")
    stretches = scratch_table(texts.mapInArrow(bytes_of, "th long, nb int, packed long, raw binary").withColumn("sid", F.monotonically_increasing_id()), "stretches")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of the bytes that all windows of a slice share, and of all bytes they
        cover.  A window that starts t bytes before its anchor starts at far - t here."""
        for batch in batches:
            sids, packed = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            raw, edges = flat(batch.column(2))
            for a, b in chunks(edges):
                digests = Digests(raw[edges[a]:edges[b]])
                _, near, far = _unpack(packed[a:b])
                n = far // SLICE - near // SLICE + 1
                row = np.repeat(np.arange(b - a), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n - near // SLICE, n)
                near, far, base = near[row], far[row], (edges[a:b] - edges[a])[row]
                start = base + far - k * SLICE
                first, last = np.maximum(k * SLICE, near), np.minimum(k * SLICE + SLICE - 1, far)
                shared = _mix(digests.of(start, start - SLICE + 1 + length) + k.astype(np.uint64))
                covered = _mix(digests.of(base + far - last, base + far - first + length) + (first * 256 + last).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(shared.view(np.int64)), pa.array(covered.view(np.int64)), pa.array(sids[a:b][row]), pa.array(k.astype(np.int32))], ["d", "hull", "sid", "slice"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digest and first byte of each window in the slices that have company."""
        for batch in batches:
            ths, nbs, packed = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            raw, edges = flat(batch.column(3))
            listed = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.append(0, np.cumsum(pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False)))
            for a, b in chunks(edges):
                at, near, far = _unpack(packed[a:b])
                row = np.repeat(np.repeat(np.arange(b - a), np.diff(ends[a:b + 1])), SLICE)
                t = (listed[ends[a]:ends[b], None] * SLICE + np.arange(SLICE)).ravel()
                some = (t >= near[row]) & (t <= far[row])
                t, row = t[some], row[some]
                start = (edges[a:b] - edges[a] + far)[row] - t
                named = _mix(Digests(raw[edges[a]:edges[b]]).of(start, start + length) + t.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(named.view(np.int64)), pa.array(ths[a:b][row]), pa.array(nbs[a:b][row]), pa.array(at[row] - t)], ["d", "th", "nb", "start"])

    sliced = stretches.select("sid", "packed", "raw").mapInArrow(slices, "d long, hull long, sid long, slice int")
    sliced = sliced.join(sliced.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d"), "d", "left_semi")
    again = sliced.groupBy("hull").agg(F.count("*").alias("n")).filter("n > 1")
    sliced = scratch_table(sliced.join(again, "hull", "left").select("d", "hull", "sid", "slice", F.col("n").isNotNull().alias("whole")), "slices")
    unresolved = sliced.filter("not whole")
    standing = sliced.filter("whole").join(unresolved.select("d").distinct(), "d", "left_semi")
    standing = standing.withColumn("turn", F.row_number().over(Window.partitionBy("d", "hull").orderBy("sid"))).filter("turn = 1").drop("turn")
    alive = unresolved.unionByName(standing).groupBy("sid").agg(F.collect_set("slice").alias("slices"))
    single = scratch_table(stretches.join(alive, "sid").select("th", "nb", "packed", "raw", "slices").mapInArrow(windows, "d long, th long, nb int, start long"), "windows")
    hits = single.join(single.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d"), "d", "left_semi").select("th", "nb", "start", (F.col("start") + length).alias("stop"))

    at, near, far = (F.shiftright("packed", 32), F.shiftright("packed", 24).bitwiseAND(F.lit(255)), F.shiftright("packed", 16).bitwiseAND(F.lit(255)))
    whole = rows.filter("whole").select("th", "nb", (at - far).alias("start"), (at - near + length).alias("stop"))
    first, last = F.greatest(F.col("slice") * SLICE, near), F.least(F.col("slice") * SLICE + SLICE - 1, far)
    slice_hits = sliced.filter("whole").select("sid", "slice").join(stretches.select("sid", "th", "nb", "packed"), "sid").select("th", "nb", (at - last).alias("start"), (at - first + length).alias("stop"))
    both = whole.unionByName(slice_hits).unionByName(hits).select("th", "nb", F.shiftleft("start", 32).bitwiseOR(F.col("stop")).alias("range"))
    return both.groupBy("th", "nb").agg(F.collect_set("range").alias("ranges"))


def merged(ranges: list[int] | None) -> np.ndarray:
    """Maximal stretches (first byte, byte after the last) of packed ranges."""
    if not ranges:
        return np.zeros((0, 2), np.int64)
    packed = np.sort(np.array(ranges, np.int64))
    start, stop = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    return np.stack([start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]], axis=1)


def to_characters(raw: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Spans moved outwards to the borders of UTF-8 characters, joined where they then meet."""
    out: list[list[int]] = []
    for start, stop in spans:
        while 0 < start < len(raw) and raw[start] & 0xC0 == 0x80:
            start -= 1
        while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop += 1
        if out and start <= out[-1][1]:
            out[-1][1] = stop
        else:
            out.append([start, stop])
    return out


def remove_repeats(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM, carry: Sequence[str] = (), characters: bool = False) -> DataFrame:
    """``key``, ``n_bytes``, ``spans`` (array of structs start, stop: removed bytes,
    ascending), ``kept`` (binary: the remaining bytes) and, with ``carry``, a struct
    ``row`` of those columns; a row per input row.  With ``characters``, a character
    that a span cuts in two goes whole."""
    src = with_row(df, carry, key=id_col, text=F.coalesce(df[text_col], F.lit("")))
    src = src.withColumns({"th": F.xxhash64("text"), "nb": F.octet_length("text").bitwiseAND(F.lit(SIZE_MASK)).cast("int")})
    spans = repeated_spans(src, length, gram)
    schema = T.StructType([T.StructField("key", src.schema["key"].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField("kept", T.BinaryType()), *handed_on(src)])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, listed, kept, at, held = [], [], [], 0, 0

            def out(upto, batch=batch):
                return pa.RecordBatch.from_arrays([batch.column(0)[at:upto], pa.array(sizes, pa.int64()), pa.array(listed, span_type), pa.array(kept, pa.binary()), *[c[at:upto] for c in batch.columns[3:]]], schema.names)

            for i, (text, ranges) in enumerate(zip(batch.column(1), batch.column(2))):
                raw = text.as_buffer().to_pybytes()
                gone = merged(ranges.as_py()).tolist()
                if characters:
                    gone = to_characters(raw, gone)
                edges = [0, *(x for span in gone for x in span), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(raw))
                listed.append([{"start": a, "stop": b} for a, b in gone])
                held += len(kept[-1])
                if held > BATCH_BYTES:
                    yield out(i + 1)
                    sizes, listed, kept, at, held = [], [], [], i + 1, 0
            if sizes:
                yield out(batch.num_rows)

    return src.join(spans, ["th", "nb"], "left").select("key", "text", "ranges", *[f.name for f in handed_on(src)]).mapInArrow(cut, schema)
