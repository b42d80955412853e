"""Chunks of long texts, pre-tokenised apart and stitched, against the whole texts."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from panelforge.llm import chunk_bpe, queries

SF = "/root/testdata/sf0.001"
RANKS = P.path(queries.MULTI_RANKS)


def ids(text):
    return np.array(chunk_bpe.encoding(RANKS, P.PATTERN).encode_ordinary(text or ""), "<u4").tobytes()


@pytest.mark.parametrize("chunk,overlap", [(24, 8), (40, 39), (300, 5)])
def test_stitched_pieces_encode_as_whole_texts(spark, chunk, overlap):
    rng = random.Random(chunk)
    parts = ["a", "bc", " ", "  ", "\n", "'", "'re", "é", "1", "!", "\t", "　", "漢字", "x" * 70, " " * 60, "7" * 90, "word " * 9]
    rows = [(rng.choice([None, 1, 2, i]), "".join(rng.choices(parts, k=rng.randint(0, 150)))) for i in range(150)]
    rows += [(5, "z" * 3000), (5, " " * 3000), (6, "z" * 3000 + "! " + "y" * 500 + " end"), (7, None), (7, ""), (None, "\n" * 2000 + "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = chunk_bpe.encode_documents(df, "doc_id", "text", RANKS, P.PATTERN, chunk, overlap).collect()
    assert Counter((r["key"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == Counter((i, ids(t), (t or "").encode()) for i, t in rows)


def test_pieces_of_a_text_are_many_rows(spark):
    text = " ".join(f"word{i}" for i in range(4000))
    df = spark.createDataFrame([(1, text), (2, "q" * 5000)], "key long, text string")
    rows = chunk_bpe.pieces(df, P.PATTERN, 100, 20).collect()
    mine = sorted((r for r in rows if r["key"] == 1), key=lambda r: r["c"])
    assert len(mine) > 300 and "".join(r["text"][r["begin"]:r["stop"]] for r in mine) == text
    assert [r["text"] for r in rows if r["key"] == 2] == ["q" * 5000]  # one pre-token stays one piece


def test_overlap_must_be_less_than_a_chunk(spark):
    with pytest.raises(ValueError):
        chunk_bpe.encode_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text", RANKS, P.PATTERN, 8, 8)


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = Counter((r["doc_id"], len(ids(r["text"])) // 4, sha(ids(r["text"])), sha((r["text"] or "").encode())) for r in docs)
    got = queries.QUERIES["op10_chunked_bpe"](spark, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
