"""Runs of periodically repeated words, by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q and at least
``max(MIN_RUN, 2 * q)`` words that no neighbouring word extends with period q.

1. *Splitting.*  Every word of a run occurs at least twice in it.  So a word
   that occurs once within a segment is in no run: it splits the segment, and so
   on within the parts until nothing more is rare.  Parts of fewer than
   ``MIN_RUN`` words go.  All segments of a batch are split together, and only
   those that changed are looked at again.
2. *Lag scan* of the segments that survive.  A run of period p has at least
   ``max(p, MIN_RUN - p)`` consecutive matches at lag p, so it is met by a probe
   at every such multiple: about m * ln(m) probes for m words, in arrays.  A
   probe that matches is extended both ways.  Lags are taken in ascending order;
   a stretch inside a run whose period divides the lag is that run
   again, so every other stretch has the lag as its smallest period.

The scan runs in batches of whole rows and shuffles nothing; a document's memory
is a small multiple of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelforge.llm.common import BATCH_BYTES, slim

#: Fewest words of a run.
MIN_RUN = 12
#: Segments of at most so many words share one table of probes; words split together, probes tried together.
SHARED_WORDS, SPLIT_WORDS, PROBES = 1 << 14, 1 << 18, 1 << 20
#: Matches looked for on either side of a probe before it is extended.
NEAR = MIN_RUN // 2


def surviving_segments(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, stop) of the segments left of the texts between ``bounds``, in order.
    ``ids`` are word numbers from 0 that no two texts share."""
    done, first = [], True
    start, stop = bounds[:-1], bounds[1:]
    numbers = int(ids.max(initial=0)) + 1
    while True:
        long = stop - start >= MIN_RUN
        start, stop = start[long], stop[long]
        if not len(start):
            break
        size = stop - start
        seg = np.repeat(np.arange(len(start)), size)
        pos = np.arange(len(seg)) + np.repeat(start - np.cumsum(size) + size, size)
        if first:  # a word's number says its text
            rare = np.bincount(ids, minlength=numbers)[ids[pos]] < 2
        else:
            _, at, count = np.unique(seg * numbers + ids[pos], return_inverse=True, return_counts=True)
            rare = count[at] < 2
        split = np.zeros(len(start), bool)
        split[seg[rare]] = True
        done.append(np.stack([start[~split], stop[~split]], 1))
        live = split[seg] & ~rare
        pos, seg = pos[live], seg[live]
        new = np.flatnonzero((np.diff(pos, prepend=-2) != 1) | (np.diff(seg, prepend=-1) != 0))
        start, stop, first = pos[new], pos[np.append(new[1:], len(pos)) - 1] + 1 if len(pos) else pos, False
    out = np.concatenate(done) if done else np.empty((0, 2), np.int64)
    return out[np.argsort(out[:, 0])]


def probes_between(m: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Probes (start, lag) of the lags low .. high - 1 over m words."""
    lag = np.arange(low, high)
    step = np.maximum(lag, MIN_RUN - lag)
    count = (m - lag - 1) // step + 1
    step, lag, ends = np.repeat(step, count), np.repeat(lag, count), np.cumsum(count)
    return (np.arange(len(lag)) - np.repeat(ends - count, count)) * step, lag


@lru_cache(maxsize=1)
def shared_probes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All probes up to ``SHARED_WORDS``, by the fewest words at which each is one."""
    start, lag = probes_between(SHARED_WORDS, 1, SHARED_WORDS // 2 + 1)
    need = np.maximum(start + lag + 1, 2 * lag)
    order = np.argsort(need, kind="stable")
    return need[order], start[order], lag[order]


def probe_blocks(m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All probes over m words in blocks of bounded size, lags ascending from block to block."""
    if m <= SHARED_WORDS:
        need, start, lag = shared_probes()
        n = int(np.searchsorted(need, m, "right"))
        yield start[:n], lag[:n]
        return
    low, last = 1, m // 2
    while low <= last:
        high = min(last + 1, low + max(1, PROBES * max(low, MIN_RUN - low) // m))
        yield probes_between(m, low, high)
        low = high


def near_matches(words: np.ndarray, start: np.ndarray, lag: np.ndarray, way: int) -> np.ndarray:
    """Matches directly beside each probe, to the right (1) or the left (-1), up to ``NEAR``."""
    found, at = np.zeros(len(start), np.int64), np.arange(len(start))
    for t in range(1, NEAR + 1):
        i = start[at] + way * t
        at = at[(i >= 0) & (i + lag[at] < len(words))]
        i = start[at] + way * t
        at = at[words[i] == words[i + lag[at]]]
        found[at] += 1
    return found


def reach(words: np.ndarray, i: int, lag: int, way: int) -> int:
    """How many consecutive positions from ``i`` match at the lag, going right (1) or left (-1)."""
    total, width = 0, 64
    while True:
        if way > 0:
            x, y = words[i + total:i + total + width], words[i + total + lag:i + total + lag + width]
            differ = x[:len(y)] != y
        else:
            stop = i - total + 1
            a = max(0, stop - width)
            differ = (words[a:stop] != words[a + lag:stop + lag])[::-1]
        if not len(differ):
            return total
        if differ.any():
            return total + int(differ.argmax())
        total += len(differ)
        width *= 2


def segment_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment."""
    found: list[tuple[int, int, int]] = []
    known = np.empty((0, 3), np.int64)  # start, stop, period of runs longer than the lag
    for start, lag in probe_blocks(len(words)):
        hit = words[start] == words[start + lag]
        start, lag = start[hit], lag[hit]
        hit = near_matches(words, start, lag, 1) + near_matches(words, start, lag, -1) + 1 >= NEAR
        start, lag = start[hit], lag[hit]
        order = np.lexsort((start, lag))
        start, lag = start[order], lag[order]
        firsts = np.flatnonzero(np.diff(lag, prepend=0))
        for a, b in zip(firsts, np.append(firsts[1:], len(lag))):
            p, here = int(lag[a]), start[a:b]
            known = known[known[:, 1] - known[:, 0] > p]
            over = known[p % known[:, 2] == 0]
            delta = np.zeros(len(here) + 1, np.int64)
            np.add.at(delta, np.searchsorted(here, over[:, 0]), 1)
            np.add.at(delta, np.searchsorted(here, over[:, 1] - p), -1)
            upto, new = 0, []
            for i in here[np.cumsum(delta[:-1]) == 0].tolist():
                if i < upto:
                    continue
                right, left = reach(words, i, p, 1), reach(words, i, p, -1)
                upto = i + right
                if upto - (i - left + 1) >= max(p, MIN_RUN - p):
                    new.append((i - left + 1, upto + p, p))
            if new:
                known = np.concatenate([known, np.array(new)])
                found += [(s, e - s, p) for s, e, p in new]
    return found


def text_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words: by start, then period."""
    parts, bounds, numbers = [], [0], 0
    for words in texts:
        code = dict(zip(dict.fromkeys(words), range(numbers, numbers + len(words))))
        parts.append(np.fromiter(map(code.__getitem__, words), np.int64, len(words)))
        numbers += len(code)
        bounds.append(bounds[-1] + len(words))
    ids, edges = np.concatenate([*parts, np.empty(0, np.int64)]), np.array(bounds)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in surviving_segments(ids, edges).tolist():
        k = int(np.searchsorted(edges, a, "right")) - 1
        out[k] += [(a - bounds[k] + s, n, p) for s, n, p in segment_runs(ids[a:b])]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those after the first period of a run."""
    if not runs:
        return b" ".join(words)
    delta = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        delta[s + p] += 1
        delta[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(delta[:-1]) == 0).tolist()])


def find_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: ``key``, ``n_words``, ``runs`` (start and length in
    words from 0, period; by start, then period) and ``collapsed`` (the words joined
    by one space without those after a run's first period).

    Words are what ASCII white space separates.  NULL, empty and white texts have no
    words, no runs and an empty ``collapsed``.  Repeated rows and NULL ids are
    rows like others, other columns are not read, an empty table gives an empty result.
    """
    src = slim(df, key=id_col, text=text_col)
    one = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
    schema = T.StructType([T.StructField("key", src.schema["key"].dataType), T.StructField("n_words", T.LongType(), False),
                           T.StructField("runs", T.ArrayType(one, False), False), T.StructField("collapsed", T.BinaryType(), False)])
    runs_type = pa.list_(pa.struct([(n, pa.int64()) for n in one.names]))

    def rows(keys: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = text_runs(texts)
        runs = [[dict(zip(one.names, r)) for r in these] for these in found]
        return pa.RecordBatch.from_arrays([keys, pa.array([len(w) for w in texts], pa.int64()), pa.array(runs, runs_type),
                                           pa.array(list(map(collapse, texts, found)), pa.binary())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, n_words, n_bytes = [], 0, 0, 0
            for i, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode()
                texts.append(data.split())
                n_words, n_bytes = n_words + len(texts[-1]), n_bytes + len(data)
                if n_words > SPLIT_WORDS or n_bytes > BATCH_BYTES:
                    yield rows(batch.column(0)[at:i + 1], texts)
                    texts, at, n_words, n_bytes = [], i + 1, 0, 0
            if texts:
                yield rows(batch.column(0)[at:], texts)

    return src.mapInArrow(run, schema)
