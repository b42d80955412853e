"""Exact quantiles by digit refinement, one algorithm for every size.

A double has an order-preserving 64-bit image (:func:`images`).  The image's
range is cut into at most ``2 ** DIGIT_BITS + 1`` bins, the rows of each bin are counted
(map-side combine; all columns in one pass), and the bin that
holds a wanted rank becomes the next, smaller range, until it holds one value.  A
double has 64 bits, so six passes over the images always suffice; usually two or three do.
Nothing is ever sorted but bin counts, and a task holds no more than
them, whatever share of the rows a group has.

Without groups the ranges are a few numbers, which each pass has as literals.
With groups they are a table with one row per group, joined to the rows; its
size decides how.  Only rows inside a range that is still open are counted.

Interpolation is the pandas / NumPy default ("linear"):
h = (n-1)·p, q = x[⌊h⌋] + (h-⌊h⌋)·(x[⌊h⌋+1] - x[⌊h⌋]).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from panelforge.session import written

DIGIT_BITS = 12
# A target (column, p) is n values, the wanted rank k, its range lo .. hi, the rows below the range
# and up to its end, and the first value above it.
MANTISSA = 1 << 52


def images(df: DataFrame, columns: dict[str, str], carry: dict[str, str] | None = None) -> DataFrame:
    """Order-preserving 64-bit images of doubles: their bits, negated for negative
    numbers.  NULL and NaN have none; -0.0 and 0.0 have one.  ``columns`` and ``carry``
    map names of the result to columns of ``df``.

    The bits come from exact arithmetic: x = m * 2^e with m in [1, 2), in steps that
    each name what the next one uses more than once."""
    carry, out = carry or {}, list(columns)
    kept = [F.col(c) for c in carry]
    d = df.select(*[F.col(c).alias(o) for o, c in carry.items()], *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(o) for o, c in columns.items()])
    # numbers below 2^-1000 are scaled up, so that 2^e never leaves the normal range
    d = d.select(*kept, *out, *[(F.abs(o) * F.when(F.abs(o) < 2.0 ** -1000, 2.0 ** 100).otherwise(1.0)).alias(f"{o}_a") for o in out])
    d = d.select(*kept, *out, *[f"{o}_a" for o in out], *[F.least(F.floor(F.log2(F.when(F.col(f"{o}_a") < math.inf, F.col(f"{o}_a")))).cast("double"), F.lit(1023.0)).alias(f"{o}_e") for o in out])
    d = d.select(*kept, *out, *[f"{o}_{x}" for o in out for x in "ae"], *[(F.col(f"{o}_a") / F.pow(F.lit(2.0), F.col(f"{o}_e"))).alias(f"{o}_m") for o in out])

    def bits(o: str) -> Column:
        x, a, e, m = F.col(o), F.col(f"{o}_a"), F.col(f"{o}_e"), F.col(f"{o}_m")
        up = F.when(m >= 2, 1).when(m < 1, -1).otherwise(0)  # the logarithm may be off next to a power of two
        fraction = F.when(m >= 2, m / 2 - 1).when(m < 1, m * 2 - 1).otherwise(m - 1)
        tiny = F.abs(x) < 2.0 ** -1000
        exponent = e.cast("long") + up - F.when(tiny, 100).otherwise(0) + 1023
        whole = (F.when(a == 0, F.lit(0).cast("long")).when(a == math.inf, F.lit(2047 * MANTISSA).cast("long"))
                 .when(tiny & (a < 2.0 ** (100 - 1022)), (a / 2.0 ** (100 - 1074)).cast("long"))
                 .otherwise(exponent * MANTISSA + (fraction * float(MANTISSA)).cast("long")))
        return whole * F.when(x < 0, -1).otherwise(1)

    return d.select(*kept, *[bits(o).alias(o) for o in out])


def value(img: Column) -> Column:
    """The double of an image."""
    bits = F.abs(img)
    e, m = F.shiftright(bits, 52).cast("double"), F.pmod(bits, F.lit(MANTISSA)).cast("double")
    a = (F.when(e == 2047, F.lit(math.inf)).when(e == 0, m * 2.0 ** -1074)
         .otherwise((1 + m / float(MANTISSA)) * F.pow(F.lit(2.0), e - 1023)))
    return F.when(img < 0, -a).otherwise(a)


def _value(img: int) -> float:
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(img)))[0], img)


def _digit_shift(lo: Column, hi: Column) -> Column:
    span = F.shiftright(hi, 1) - F.shiftright(lo, 1)
    return F.greatest(F.lit(0), F.floor(F.log2(span + F.lit(1.0))).cast("int") + 2 - DIGIT_BITS)


def _bins(rows: DataFrame, keys: Sequence[str], slots: dict[int, str], get: Callable[[int, str], Column]) -> DataFrame:
    """Counts and extremes of the bins of every slot's range, with the rows before each bin and
    the least image after it.  ``slots`` maps a slot (a target's number) to its image column."""
    cells, inside = [], []
    for t, column in slots.items():
        lo, hi, v = get(t, "lo"), get(t, "hi"), F.col(column)
        here = (lo < hi) & (v >= lo) & (v <= hi)
        s = _digit_shift(lo, hi)
        digit = F.call_function("shiftright", v, s) - F.call_function("shiftright", lo, s)
        inside.append(F.coalesce(here, F.lit(False)))
        cells.append(F.when(here, F.struct(F.lit(t).alias("slot"), digit.alias("bin"), v.alias("v"))))
    cells = rows.filter(reduce(lambda a, b: a | b, inside)).select(*keys, F.explode(F.array(*cells)).alias("c")).filter("c is not null")
    bins = cells.select(*keys, "c.*").groupBy(*keys, "slot", "bin").agg(F.count("*").alias("cnt"), F.min("v").alias("least"), F.max("v").alias("most"))
    order = W.partitionBy(*keys, "slot").orderBy("bin")  # at most 2^DIGIT_BITS + 1 rows
    return bins.withColumns({"before": F.coalesce(F.sum("cnt").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")), "after": F.lead("least").over(order)})


def _found(bins: DataFrame, keys: Sequence[str], slot_of: Sequence[int], get: Callable[[int, str], Column]) -> DataFrame:
    """Per key, the new range of every target whose slot was counted (else NULLs)."""
    aggs = []
    for t, slot in enumerate(slot_of):
        start = get(t, "below") + F.col("before")
        hit = (F.col("slot") == slot) & (start <= get(t, "k")) & (get(t, "k") < start + F.col("cnt"))
        aggs += [F.max(F.when(hit, x)).alias(f"_{f}{t}") for f, x in
                 (("lo", F.col("least")), ("hi", F.col("most")), ("below", start), ("upto", start + F.col("cnt")), ("above", F.col("after")))]
    return bins.groupBy(*keys).agg(*aggs)


def exact_quantiles(df: DataFrame, columns, probs, by=(), feature_col: str = "Feature") -> DataFrame:
    """Long result (by..., Feature, p, q, n) of exact linear quantiles.

    NULL and NaN are ignored (pandas ``quantile`` skips NaN); a group with no
    value gives NULL and n = 0, NULL in ``by`` is a group like others, and an empty
    table gives one row per column and p without ``by``, none with it."""
    by, columns, probs = list(by), list(columns), [float(p) for p in probs]
    if not columns or not probs:
        raise ValueError("exact_quantiles needs a column and a probability")
    targets = [(j, p) for j in range(len(columns)) for p in probs]
    keys = [f"_k{i}" for i in range(len(by))]
    rows = written(images(df, {f"_v{j}": c for j, c in enumerate(columns)}, dict(zip(keys, by))), "quantile-images")
    ranges = rows.groupBy(*keys).agg(*[a for j in range(len(columns)) for a in
                                       (F.count(f"_v{j}").alias(f"_n{j}"), F.min(f"_v{j}").alias(f"_min{j}"), F.max(f"_v{j}").alias(f"_max{j}"))])
    if by:
        return _grouped(rows, ranges, by, keys, columns, targets, feature_col)
    return _overall(rows, ranges, columns, targets, feature_col)


def _slots(targets: Sequence[tuple[int, float]], first: bool) -> list[int]:
    """The slot of every target: at first all targets of a column share the column's whole range."""
    return [next(i for i, (j, _) in enumerate(targets) if j == column) if first else t for t, (column, _) in enumerate(targets)]


def _overall(rows: DataFrame, ranges: DataFrame, columns, targets, feature_col: str) -> DataFrame:
    """Targets are a few numbers on the driver, literals in each pass."""
    got = ranges.first()
    state = []
    for j, p in targets:
        n = got[f"_n{j}"]
        state.append({"n": n, "k": math.floor((n - 1) * p) if n else None, "lo": got[f"_min{j}"], "hi": got[f"_max{j}"], "below": 0, "upto": n, "above": None})

    def get(t: int, field: str) -> Column:
        return F.lit(state[t][field]).cast("long")

    first = True
    while any(s["n"] and s["lo"] < s["hi"] for s in state):
        slot_of = _slots(targets, first)
        slots = {t: f"_v{targets[t][0]}" for t in set(slot_of) if state[t]["n"] and state[t]["lo"] < state[t]["hi"]}
        new = _found(_bins(rows, [], slots, get), [], slot_of, get).first()
        for t, s in enumerate(state):
            if new[f"_lo{t}"] is not None:
                s.update({f: new[f"_{f}{t}"] for f in ("lo", "hi", "below", "upto")} | {"above": new[f"_above{t}"] if new[f"_above{t}"] is not None else s["above"]})
        first = False
    out = []
    for (j, p), s in zip(targets, state):
        q = None
        if s["n"]:
            x0 = _value(s["lo"])
            x1 = x0 if s["k"] + 1 < s["upto"] or s["above"] is None else _value(s["above"])
            frac = (s["n"] - 1) * p - s["k"]
            q = x0 + frac * (x1 - x0) if frac else x0
        out.append((columns[j], p, q, s["n"]))
    return rows.sparkSession.createDataFrame(out, f"`{feature_col}` string, p double, q double, n long")


def _grouped(rows: DataFrame, ranges: DataFrame, by, keys, columns, targets, feature_col: str) -> DataFrame:
    """Targets are structs in a table of one row per group."""
    def get(t: int, field: str) -> Column:
        return F.col(f"_t{t}")[field]

    def target(j: int, p: float) -> Column:
        n = F.col(f"_n{j}")
        return F.struct(n.alias("n"), F.when(n > 0, F.floor((n - 1) * p)).cast("long").alias("k"), F.col(f"_min{j}").alias("lo"), F.col(f"_max{j}").alias("hi"),
                        F.lit(0).cast("long").alias("below"), n.alias("upto"), F.lit(None).cast("long").alias("above"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])

    state = written(ranges.select(*keys, *[target(j, p).alias(f"_t{t}") for t, (j, p) in enumerate(targets)]), "quantile-ranges")
    still = reduce(lambda a, b: a | b, [F.coalesce(get(t, "lo") < get(t, "hi"), F.lit(False)) for t in range(len(targets))])
    first = True
    while not (active := state.filter(still)).isEmpty():
        slot_of = _slots(targets, first)
        slots = {t: f"_v{targets[t][0]}" for t in sorted(set(slot_of))}
        here = rows.join(active, same(rows, active)).select(*[rows[k] for k in keys], *[f"_v{j}" for j in range(len(columns))], *[f"_t{t}" for t in range(len(targets))])
        bins = _bins(here, keys, slots, get)
        bins = bins.join(active, same(bins, active)).select(*[bins[k] for k in keys], "slot", "bin", "cnt", "least", "most", "before", "after", *[f"_t{t}" for t in range(len(targets))])
        found = _found(bins, keys, slot_of, get)
        new = [F.when(F.col(f"_lo{t}").isNotNull(), F.struct(get(t, "n").alias("n"), get(t, "k").alias("k"), *[F.col(f"_{f}{t}").alias(f) for f in ("lo", "hi", "below", "upto")],
                                                             F.coalesce(F.col(f"_above{t}"), get(t, "above")).alias("above"))).otherwise(F.col(f"_t{t}")).alias(f"_t{t}")
               for t in range(len(targets))]
        state = written(state.join(found, same(state, found), "left").select(*[state[k] for k in keys], *new), "quantile-ranges")
        first = False
    cells = [F.struct(F.lit(columns[j]).alias(feature_col), F.lit(p).alias("p"), F.col(f"_t{t}").alias("_t")) for t, (j, p) in enumerate(targets)]
    long = state.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.inline(F.array(*cells)))
    n, k, x0 = F.col("_t.n"), F.col("_t.k"), value(F.col("_t.lo"))
    x1 = F.when((k + 1 < F.col("_t.upto")) | F.col("_t.above").isNull(), x0).otherwise(value(F.col("_t.above")))
    frac = (n - 1) * F.col("p") - k
    return long.select(*by, feature_col, "p", F.when(frac == 0, x0).otherwise(x0 + frac * (x1 - x0)).alias("q"), n.alias("n"))


def quantile_row(df: DataFrame, columns, probs) -> dict:
    """Fitted-parameter form: {column: [q(p) for p in probs]} on the driver
    (size = columns x probs, independent of the row count)."""
    out = {c: [None] * len(probs) for c in columns}
    at = {float(p): i for i, p in enumerate(probs)}
    for r in exact_quantiles(df, columns, probs).collect():
        out[r["Feature"]][at[r["p"]]] = r["q"]
    return out
