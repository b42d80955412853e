"""Linear recurrences along an entity's series, as an affine prefix scan.

y_t = x_t + a_1 * y_{t-1} + ... + a_r * y_{t-r} maps the last r values (the state)
to the next ones affinely, and affine maps compose.  So a series is cut into blocks
of rows by position, and

1. every block is run from a state of zeros: its end is the constant part of its map, the
   linear part is a power of the companion matrix;
2. the maps are composed along each entity (one small vector per block);
3. every block is run again from the state at its start.

An entity's blocks are independent tasks in 1 and 3, so a hot entity is spread over many.
Within a task the series of a batch advance together, step by step, as NumPy vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import written

#: Rows of a block, and values that advance together.
BLOCK_ROWS, STEP_VALUES = 4096, 1 << 20


def _lists(column: pa.Array) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(np.diff(column.offsets.to_numpy()))
    return np.split(values, ends[:-1]) if len(ends) else []


def _advance(xs: Sequence[np.ndarray], coef: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
    """The y of every series; ``coef`` and ``state`` have a row each, the latest value first."""
    out: list[np.ndarray] = [np.empty(0)] * len(xs)
    order = sorted(range(len(xs)), key=lambda i: len(xs[i]))
    at = 0
    while at < len(order):
        some = order[at:at + max(1, STEP_VALUES // max(1, len(xs[order[-1]])))]
        at += len(some)
        x = np.zeros((len(some), len(xs[some[-1]])))
        for r, i in enumerate(some):
            x[r, :len(xs[i])] = xs[i]
        a, s = coef[some], state[some].copy()
        for t in range(x.shape[1]):
            x[:, t] += (a * s).sum(axis=1)
            s[:, 1:] = s[:, :-1]
            s[:, 0] = x[:, t]
        for r, i in enumerate(some):
            out[i] = x[r, :len(xs[i])]
    return out


def _end_state(start: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([y[::-1], start])[:len(start)]


def _companion(coef: np.ndarray) -> np.ndarray:
    m = np.eye(len(coef), k=-1)
    m[0] = coef
    return m


def _blocks(df: DataFrame, entity: str, pos: str, x: str, coef: str, init: str, keep: Sequence[str], rows: int) -> DataFrame:
    block = F.floor((F.col(pos) - 1) / rows).cast("long")
    cells = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("_pos"), F.col(x).cast("double").alias("_x"), *keep)))  # at most BLOCK_ROWS
    return df.groupBy(F.col(entity).alias("_entity"), block.alias("_block")).agg(cells.alias("_cells"), F.any_value(coef).alias("_coef"), F.any_value(init).alias("_init"))


def _starts(blocks: DataFrame) -> DataFrame:
    """(_entity, _block, _state): the state at the start of every block, and of one block after the last."""
    etype = blocks.schema["_entity"].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                coef = np.array(_lists(b.column("_coef")))
                xs = _lists(b.column("_xs"))
                zero = np.zeros_like(coef)
                ends = [_end_state(z, y).tolist() for z, y in zip(zero, _advance(xs, coef, zero))]
                yield pa.RecordBatch.from_arrays([b.column("_entity"), b.column("_block"), pa.array([len(x) for x in xs], pa.int64()), pa.array(ends, pa.list_(pa.float64())),
                                                  b.column("_coef"), b.column("_init")], ["_entity", "_block", "_n", "_end", "_coef", "_init"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entity, block, state = [], [], []
            for e, maps, coef, init in zip(b.column("_entity"), b.column("_maps").to_pylist(), b.column("_coef").to_pylist(), b.column("_init").to_pylist()):
                s, m = np.array(init, float), _companion(np.array(coef, float))
                for one in maps:
                    entity.append(e.as_py())
                    block.append(one["_block"])
                    state.append(s.tolist())
                    s = np.linalg.matrix_power(m, one["_n"]) @ s + np.array(one["_end"])
                entity.append(e.as_py())
                block.append(None)
                state.append(s.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(entity, b.schema.field("_entity").type), pa.array(block, pa.int64()), pa.array(state, pa.list_(pa.float64()))],
                                             ["_entity", "_block", "_state"])

    maps = blocks.select("_entity", "_block", F.col("_cells._x").alias("_xs"), "_coef", "_init")
    maps = maps.mapInArrow(local, f"_entity {etype}, _block long, _n long, _end array<double>, _coef array<double>, _init array<double>")
    maps = maps.groupBy("_entity").agg(F.sort_array(F.collect_list(F.struct("_block", "_n", "_end"))).alias("_maps"), F.any_value("_coef").alias("_coef"), F.any_value("_init").alias("_init"))
    return maps.mapInArrow(fold, f"_entity {etype}, _block long, _state array<double>")


def final_state(df: DataFrame, entity: str, pos: str, x: str, coef: str, init: str, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """(entity, out): the last values of y, as many as coefficients, the latest first."""
    ends = _starts(_blocks(df, entity, pos, x, coef, init, [], rows)).filter("_block IS NULL")
    return ends.select(F.col("_entity").alias(entity), F.col("_state").alias(out))


def linear_recurrence(df: DataFrame, entity: str, pos: str, x: str, coef: str, init: str, out: str, keep: Sequence[str] = (), rows: int = BLOCK_ROWS) -> DataFrame:
    """(entity, keep..., out) with out = y along ``pos`` (positions from 1, gaps allowed).

    ``coef`` (a_1 ... a_r) and ``init`` (the r values before the first, the latest
    first) are array columns that agree within an entity; all entities have one r > 0.
    A NULL entity is an entity; NULL and NaN in ``x`` make all later values NaN.
    """
    blocks = written(_blocks(df, entity, pos, x, coef, init, list(keep), rows), "series-blocks")
    starts = _starts(blocks)
    joined = blocks.join(starts, blocks["_entity"].eqNullSafe(starts["_entity"]) & (blocks["_block"] == starts["_block"]))
    joined = joined.select(blocks["_entity"], "_cells", F.col("_cells._x").alias("_xs"), "_coef", "_state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ys = _advance(_lists(b.column("_xs")), np.array(_lists(b.column("_coef"))), np.array(_lists(b.column("_state"))))
                yield pa.RecordBatch.from_arrays([b.column("_entity"), b.column("_cells"), pa.array([y.tolist() for y in ys], pa.list_(pa.float64()))], ["_entity", "_cells", "_ys"])

    etype, ctype = (joined.schema[c].dataType.simpleString() for c in ("_entity", "_cells"))
    done = joined.mapInArrow(run, f"_entity {etype}, _cells {ctype}, _ys array<double>")
    done = done.select("_entity", F.explode(F.arrays_zip("_cells", "_ys")).alias("_r"))
    return done.select(F.col("_entity").alias(entity), *[F.col(f"_r._cells.{c}").alias(c) for c in keep], F.col("_r._ys").alias(out))
