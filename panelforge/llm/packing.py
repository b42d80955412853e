"""Order-preserving packing of documents into windows of ``window`` tokens.

Documents are put in id order (range partitions), encoded, closed with an
end id and read as one stream.  Cuts may fall after a document (no penalty),
after a sentence, or, inside a sentence of over window / 32 tokens, after
every window / 64 tokens (at a higher penalty).  With f(j) the least cost of packing the stream
up to cut j, and windows padded to full length,

    f(j) = min over cuts i in [j - window, j) of f(i) + (window - (j - i)) + penalty(j)

so f(i) + i is what is minimised over a sliding range of cuts, and a monotone
queue gives each f(j) in constant amortised time.  The programme runs per
block of ``block_tokens`` within a range partition; only a block's last
window can be left short for want of text, so memory is bounded and the
padding this adds is below window / block_tokens.

NULL texts count as empty (one piece with the end id); rows that share an id
are ordered by text hash and packed separately; rows with a NULL id come first.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.chunk_bpe import encoding
from panelforge.llm.common import slim

WINDOW, BLOCK_TOKENS = 1024, 1 << 18
SENTENCE_PENALTY, HARD_PENALTY = 2, 8


@lru_cache(maxsize=2)
def sentence_ends(path: str, pattern: str, special: tuple) -> np.ndarray:
    """Per id: does its text close a sentence or a line?"""
    enc = encoding(path, pattern, special)
    out = np.zeros(enc.n_vocab, dtype=bool)
    for i in range(enc.n_vocab):
        raw = enc.decode_single_token_bytes(i)
        out[i] = b"\n" in raw or raw.rstrip().endswith((b".", b"!", b"?"))
    return out


def choose_cuts(positions: list[int], penalties: list[int], window: int) -> list[int]:
    """Least-cost cuts: ``positions`` ascending, the last one is the end of the
    stream; consecutive positions (and 0) are at most ``window`` apart."""
    pos, best, came = [0, *positions], [0] * (len(positions) + 1), [0] * (len(positions) + 1)
    queue: deque = deque([(0, 0)])  # (f + position, index), values increasing
    for j in range(1, len(pos)):
        at = pos[j]
        while pos[queue[0][1]] < at - window:
            queue.popleft()
        value, came[j] = queue[0]
        best[j] = value + window - at + penalties[j - 1]
        value = best[j] + at
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(pos[j])
        j = came[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Positions where the stream may be cut, and what each cut costs."""
    step = max(1, window // 64)
    cost = np.full(len(ids) + 1, -1, dtype=np.int64)
    cost[1:][sentence[ids]] = SENTENCE_PENALTY
    cost[doc_ends] = 0
    found = np.flatnonzero(cost >= 0)
    starts = np.concatenate([[0], found[:-1]])
    for a, b in zip(starts[found - starts > 2 * step], found[found - starts > 2 * step]):
        inside = np.arange(a + step, b, step)
        cost[inside] = HARD_PENALTY
    found = np.flatnonzero(cost >= 0)
    return found.tolist(), cost[found].tolist()


def pack(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, special: tuple = (),
         end_id: int = 0, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: ``key``, ``start`` (tokens of its document before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset`` (tokens before it in its sequence)."""
    src = slim(df, key=id_col, text=text_col)
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    schema = T.StructType([T.StructField("key", src.schema["key"].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ends = encoding(path, pattern, special), sentence_ends(path, pattern, special)
        specials = {name for name, _ in special}
        sequence = TaskContext.get().partitionId() << 40
        keys, parts, held, key_type = [], [], 0, None

        def flush():
            nonlocal sequence, keys, parts, held
            ids = np.concatenate(parts)
            lengths = np.array([len(x) for x in parts])
            doc_ends = np.cumsum(lengths)
            cuts = np.array(choose_cuts(*candidates(ids, doc_ends, ends, window), window))
            begins = np.unique(np.concatenate([[0], doc_ends[:-1], cuts[:-1]]))
            stops = np.append(begins[1:], len(ids))
            doc, seq = np.searchsorted(doc_ends, begins, "right"), np.searchsorted(cuts, begins, "right")
            doc_starts, seq_starts = doc_ends - lengths, np.concatenate([[0], cuts[:-1]])
            raw = ids.astype("<u4")
            for a in range(0, len(begins), 20_000):
                s = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array([keys[d] for d in doc[s]], key_type), pa.array(begins[s] - doc_starts[doc[s]]), pa.array(stops[s] - begins[s]),
                    pa.array([raw[x:y].tobytes() for x, y in zip(begins[s], stops[s])], pa.binary()), pa.array(lengths[doc[s]]),
                    pa.array(sequence + seq[s]), pa.array(begins[s] - seq_starts[seq[s]])], schema.names)
            sequence += len(cuts)
            keys, parts, held = [], [], 0

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "", allowed_special=specials, disallowed_special=())
                ids.append(end_id)
                keys.append(key)
                parts.append(np.asarray(ids, dtype=np.int64))
                held += len(ids)
                if held >= block_tokens:
                    yield from flush()
        if parts:
            yield from flush()

    return src.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
