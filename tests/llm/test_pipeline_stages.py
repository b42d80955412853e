"""Every stage of the corpus pipeline on NULL and repeated ids, empty texts, repeated rows,
extra columns and an empty table."""
import random
from collections import Counter

import pytest

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, _row int, class_id long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n)) + "."


A, Y, Z = (prose(s, 120) for s in (1, 2, 3))
ROWS = [(None, A), (None, Z), (5, A), (3, Y), (7, Y), (7, prose(4, 90)), (7, prose(4, 90)), (8, None), (9, ""), (None, None), (10, "few words"), (11, "# " * 400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", 1, 2, 3) for i, t in rows], SCHEMA)


def kept(df):
    assert df.columns == list(cp.COLUMNS)
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_near_duplicates_keep_one_row_of_each_class(spark):
    got = kept(cp.near_duplicates(spark, frame(spark, ROWS), SF))
    empty = [k for k in got if not k[1]]
    assert empty == [(8, None)]  # of the empty texts, that of least id
    assert got - Counter(empty) == Counter([(5, A), (None, Z), (3, Y), (7, prose(4, 90)), (10, "few words"), (11, "# " * 400)])


def test_rules_judge_row_by_row(spark):
    got = kept(cp.quality_rules(spark, frame(spark, ROWS), SF))
    assert got == Counter([(None, A), (None, Z), (5, A), (3, Y), (7, Y), (7, prose(4, 90)), (7, prose(4, 90))])


def test_classifier_hands_rows_on_unchanged(spark):
    want = Counter((i, t) for i, t in ROWS)
    got = kept(cp.quality_classifier(spark, frame(spark, ROWS), SF))
    assert not got - want


def test_passages_and_packing(spark):
    got = kept(cp.repeated_passages(spark, frame(spark, ROWS), SF))
    assert sum(got.values()) == len(ROWS) and got[None, Z] == 1 and got[None, ""] == 2 and got[5, ""] == 1
    pieces = cp.pack(spark, frame(spark, ROWS), SF).collect()
    assert sum(r["length"] for r in pieces) == sum({(r["doc_id"], r["doc_tokens"], r["ids_crc32"], r["start"], k): r["length"] for k, r in enumerate(pieces)}.values())
    assert Counter(r["doc_tokens"] for r in pieces if r["start"] == 0)[1] == 3  # NULL and empty texts are the end mark alone


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_no_documents(spark, stage):
    assert stage(spark, frame(spark, []), SF).collect() == []
