"""Quality rules as a short-circuit cascade.

A rule reads one measure of a document and rejects the document or not.
Measures are computed on demand and kept for the document, so a rule's cost
is the time its measure takes.  ``plan_cascade`` times every rule on a sample,
counts how often it rejects there, and orders the rules by rejections per
second; ``apply_cascade`` then stops at the first rule that rejects.  The
order changes only the time: a document is kept iff no rule rejects it, and
every document is judged.

NULL and empty texts have no words (all measures 0).  Repeated rows give
repeated results; only the key column is carried along.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import by_bytes, handed_text, id_hash, rest_of_row, row_of, slim, with_row

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Rows on which costs and rejection rates are estimated (the order of the rules depends on it, no verdict does).
SAMPLE_ROWS = 2_000


class Measured:
    """A document and those of its measures that have been asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return len(SYMBOLS.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that the text has twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        codes: dict[str, int] = {}
        at = np.fromiter((codes.setdefault(w, len(codes)) for w in self.words), np.int64, n)
        if len(codes) < 1 << 21:
            windows = (at[:-2] << 42) | (at[1:-1] << 21) | at[2:]
        else:
            pairs = np.unique(at[:-1] * len(codes) + at[1:], return_inverse=True)[1]
            windows = pairs[:-1] * len(codes) + at[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(n - 2, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, dtype=bool)
        for shift in range(3):
            covered[shift: n - 2 + shift] |= twice
        return int(covered.sum())

    @cached_property
    def n_upper(self) -> int:
        """ASCII capitals."""
        return len(self.text) - len(self.text.translate(NO_CAPITALS))


NO_CAPITALS = {c: None for c in range(ord("A"), ord("Z") + 1)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measured], bool]


#: Integer comparisons only, so that every engine gives the same verdict.
RULES = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
    Rule("many_symbols", lambda d: 100 * d.n_symbols > 10 * d.word_chars),
    Rule("long_words", lambda d: d.word_chars > 12 * d.n_words),
    Rule("short_words", lambda d: 2 * d.word_chars < 5 * d.n_words),
    Rule("repeated_lines", lambda d: 100 * d.n_dup_lines > 50 * d.n_lines),
    Rule("capitals", lambda d: 100 * d.n_upper > 40 * d.word_chars),
)


def plan_cascade(df: DataFrame, id_col: str, text_col: str, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second on the ``sample_rows`` rows of least id hash."""
    src = slim(df, key=id_col, text=text_col)

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for k, rule in enumerate(rules):
                    doc, began = Measured(text), time.perf_counter()
                    hit = rule.rejects(doc)
                    out.append((k, time.perf_counter() - began, int(hit)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], ["rule", "sec", "hit"])

    # ids first: only the sampled texts are moved
    keys = src.select(id_hash(F.col("key")).alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if keys is None:
        return [r.name for r in rules]
    sample = src.filter(id_hash(F.col("key")) <= F.lit(keys)).select("text")
    found = {r["rule"]: (r["sec"], r["hit"]) for r in sample.mapInArrow(trial, "rule long, sec double, hit long").groupBy("rule").agg(F.sum("sec").alias("sec"), F.sum("hit").alias("hit")).collect()}
    rate = {k: hit / max(sec, 1e-9) for k, (sec, hit) in found.items()}
    cost = {k: sec for k, (sec, _) in found.items()}
    return [rules[k].name for k in sorted(range(len(rules)), key=lambda k: (-rate.get(k, 0), cost.get(k, 0), k))]


def apply_cascade(df: DataFrame, id_col: str, text_col: str, order: Sequence[str] | None = None, rules: Sequence[Rule] = RULES,
                  measures: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """``key``, the asked ``measures`` (long), ``kept`` and, with ``carry``, a struct ``row`` of those columns; a row per input row."""
    src = with_row(df, rest_of_row(carry, text_col), key=id_col, text=text_col)
    named = {r.name: r for r in rules}
    steps = [named[x] for x in (order or plan_cascade(df, id_col, text_col, rules))]
    if len(steps) != len(rules):
        raise ValueError("order must name every rule once")
    schema = T.StructType([T.StructField("key", src.schema["key"].dataType), *[T.StructField(m, T.LongType()) for m in measures], T.StructField("kept", T.BooleanType()), *(handed := handed_text(src, carry, text_col))])
    handed = [f.name for f in handed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 1)):
            rows, kept = [], []
            for text in batch.column(1):
                doc = Measured(text.as_py())
                kept.append(not any(rule.rejects(doc) for rule in steps))
                rows.append([getattr(doc, m) for m in measures])
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(measures))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(kept, pa.bool_()), *(batch.column(c) for c in handed)], schema.names)

    return src.mapInArrow(run, schema).select("key", *measures, "kept", *row_of(carry, text_col))
