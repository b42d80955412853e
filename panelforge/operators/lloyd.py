"""Batched k-means (ML15, ML16, CH18): every (k, restart) model moves in the same
pass over the rows.

A pass sends the centres of the live models to the tasks (sum of k x dim doubles,
no matter how many rows there are); a task adds its rows up to one record per
(model, cluster), and one grouped aggregate adds the tasks.  Converged models
leave, so a sweep needs as many jobs as its slowest model has iterations, plus
one per seeding round.  Rows with a NULL vector take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a task that are compared with all centres at once.
BLOCK_ROWS = 2048
PARTIAL = "model int, cluster int, n long, s array<double>, q double, cost double"


@dataclass
class ClusterSums:
    """Of one model's clusters: rows, vector sums, sums of squared norms, squared distances to the centres."""
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    cost: np.ndarray


def vectors(df: DataFrame, x: str, key: str | None) -> DataFrame:
    """``_x`` and a hash ``_h`` of the row (of its key if there is one, so that
    repeated vectors are drawn separately; of the vector otherwise)."""
    v = F.col(x).cast("array<double>")
    return df.filter(F.col(x).isNotNull()).select(v.alias("_x"), F.xxhash64(F.col(key) if key else v).alias("_h"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            flat = part.column(0).flatten().to_numpy(zero_copy_only=False)
            yield flat.reshape(part.num_rows, -1), part.column(1).to_numpy(zero_copy_only=False)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(1) - 2.0 * (x @ centres.T)).argmin(1)


def sums_by_cluster(data: DataFrame, models: Sequence[np.ndarray]) -> list[ClusterSums]:
    """One pass: the rows of each model's clusters, each row in that of its nearest centre."""
    models = [np.asarray(c, dtype=float) for c in models]
    dim = models[0].shape[1]

    def add_up(batches):
        sums = [ClusterSums(np.zeros(len(c), int), np.zeros_like(c), np.zeros(len(c)), np.zeros(len(c))) for c in models]
        for x, _ in _blocks(batches):
            norms = (x ** 2).sum(1)
            for c, t in zip(models, sums):
                own = _nearest(x, c)
                member = np.eye(len(c))[own]
                t.n += np.bincount(own, minlength=len(c))
                t.s += member.T @ x
                t.q += member.T @ norms
                t.cost += member.T @ ((x - c[own]) ** 2).sum(1)
        rows = [(m, j, int(t.n[j]), t.s[j].tolist(), float(t.q[j]), float(t.cost[j])) for m, t in enumerate(sums) for j in np.flatnonzero(t.n).tolist()]
        yield pa.RecordBatch.from_pylist([dict(zip(("model", "cluster", "n", "s", "q", "cost"), r)) for r in rows], schema=pa.schema(
            [("model", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("q", pa.float64()), ("cost", pa.float64())]))

    total = data.mapInArrow(add_up, PARTIAL).groupBy("model", "cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s"), F.sum("q").alias("q"), F.sum("cost").alias("cost"))
    out = [ClusterSums(np.zeros(len(c), int), np.zeros_like(c), np.zeros(len(c)), np.zeros(len(c))) for c in models]
    for r in total.collect():  # at most one row per centre
        t, j = out[r["model"]], r["cluster"]
        t.n[j], t.s[j], t.q[j], t.cost[j] = r["n"], r["s"], r["q"], r["cost"]
    return out


def _uniform(h: np.ndarray, seed: int, draw: int) -> np.ndarray:
    """A number in (0, 1) per row, seed and draw (a 64-bit mix of the row's hash)."""
    z = h.astype(np.uint64) + np.uint64((seed * 1_000_003 + draw + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def seed_centres(data: DataFrame, k: int, seeds: Sequence[int]) -> list[np.ndarray]:
    """``k`` first centres per seed, each drawn with probability proportional to the squared
    distance from those before it: the row of the least -ln(u) / d², one pass for all
    seeds.  Fewer if the rows have fewer distinct vectors.  The first j centres
    are those of a model of j clusters, so one run seeds a whole sweep."""
    chosen: list[list[np.ndarray]] = [[] for _ in seeds]
    for draw in range(k):
        live = [i for i in range(len(seeds)) if len(chosen[i]) == draw]
        before = {i: np.array(chosen[i]) for i in live}

        def least(batches, live=live, before=before, draw=draw):
            best: dict[int, tuple[float, int, list]] = {}
            for x, h in _blocks(batches):
                for i in live:
                    far = np.ones(len(x)) if not draw else np.min([((x - c) ** 2).sum(1) for c in before[i]], axis=0)
                    rank = np.where(far > 0, -np.log(_uniform(h, seeds[i], draw)) / np.where(far > 0, far, 1.0), np.inf)
                    at = int(np.lexsort((h, rank))[0])
                    if np.isfinite(rank[at]) and (i not in best or (rank[at], h[at]) < best[i][:2]):
                        best[i] = (float(rank[at]), int(h[at]), x[at].tolist())
            yield pa.RecordBatch.from_pylist([{"i": i, "rank": r, "h": h, "x": x} for i, (r, h, x) in best.items()], schema=pa.schema(
                [("i", pa.int32()), ("rank", pa.float64()), ("h", pa.int64()), ("x", pa.list_(pa.float64()))]))

        drawn = data.mapInArrow(least, "i int, rank double, h long, x array<double>").groupBy("i").agg(F.min_by("x", F.struct("rank", "h")).alias("x"))
        for r in drawn.collect():  # a row per seed
            chosen[r["i"]].append(np.array(r["x"], dtype=float))
    return [np.array(c) for c in chosen]


def move(sums: ClusterSums, centres: np.ndarray) -> np.ndarray:
    """The means of the clusters; an empty cluster keeps its centre."""
    return np.where(sums.n[:, None] > 0, sums.s / np.maximum(sums.n, 1)[:, None], centres)


def lloyd(data: DataFrame, starts: Sequence[np.ndarray], max_iter: int = 300, tol: float = 1e-6,
          on_pass: Callable[[int], None] = lambda live: None) -> list[tuple[np.ndarray, ClusterSums]]:
    """Centres and cluster sums of every model once none of its centres moves by more than
    ``tol``, or after ``max_iter`` moves.  ``on_pass`` is told how many models a pass moves."""
    centres = [np.asarray(c, dtype=float) for c in starts]
    done: dict[int, ClusterSums] = {}
    moves = 0
    while len(done) < len(centres):
        live = [m for m in range(len(centres)) if m not in done]
        on_pass(len(live))
        for m, sums in zip(live, sums_by_cluster(data, [centres[m] for m in live])):
            after = move(sums, centres[m])
            if moves >= max_iter or ((after - centres[m]) ** 2).sum(1).max() <= tol ** 2:
                done[m] = sums
            else:
                centres[m] = after
        moves += 1
    return [(centres[m], done[m]) for m in range(len(centres))]


def silhouettes(data: DataFrame, models: Sequence[tuple[np.ndarray, ClusterSums]]) -> list[float | None]:
    """Mean squared-Euclidean silhouette of every model in one pass, from the sums of its
    clusters; rows alone in a cluster count 0; None with fewer than two clusters."""
    def add_up(batches):
        total = np.zeros(len(models))
        n = 0
        for x, _ in _blocks(batches):
            n += len(x)
            norms = (x ** 2).sum(1)[:, None]
            rows = np.arange(len(x))
            for m, (centres, t) in enumerate(models):
                if (t.n > 0).sum() < 2:
                    continue
                own = _nearest(x, centres)
                to = np.maximum(norms * t.n - 2 * (x @ t.s.T) + t.q, 0.0)
                a = to[rows, own] / np.maximum(t.n[own] - 1, 1)
                to = np.where(t.n > 0, to / np.maximum(t.n, 1), np.inf)
                to[rows, own] = np.inf
                b = to.min(1)
                top = np.maximum(a, b)
                total[m] += np.where((t.n[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0).sum()
        yield pa.RecordBatch.from_pylist([{"model": m, "s": float(v), "n": n} for m, v in enumerate(total)], schema=pa.schema(
            [("model", pa.int32()), ("s", pa.float64()), ("n", pa.int64())]))

    got = {r["model"]: (r["s"], r["n"]) for r in data.mapInArrow(add_up, "model int, s double, n long").groupBy("model").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    return [got[m][0] / got[m][1] if (t.n > 0).sum() > 1 else None for m, (_, t) in enumerate(models)]


def best_models(data: DataFrame, ks: Sequence[int], seed: int, n_init: int, max_iter: int) -> dict[int, tuple[np.ndarray, ClusterSums]]:
    """Per k the restart of the lowest cost (ties: the first).  No rows: no model."""
    seeded = seed_centres(data, max(ks), [seed + i for i in range(n_init)])
    if not len(seeded[0]):
        return {}
    jobs = [(k, i) for k in ks for i in range(n_init)]
    fits = dict(zip(jobs, lloyd(data, [seeded[i][:k] for k, i in jobs], max_iter)))
    return {k: fits[min(((k, i) for i in range(n_init)), key=lambda j: (round(fits[j][1].cost.sum(), 9), j[1]))] for k in ks}
