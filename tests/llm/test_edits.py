"""The fingerprint follows edits, in text with spaces and without."""
import random

import pytest
from pyspark.sql import functions as F

from panelforge.llm import order_minhash


def near(spark, a, b):
    df = order_minhash.with_sketch(order_minhash.with_sketch(spark.createDataFrame([(a, b)], "a string, b string"), "a", "sa"), "b", "sb")
    return df.select(order_minhash.likeness(F.col("sa"), F.col("sb"))).first()[0]


def unspaced(alphabet, n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


HAN = "".join(map(chr, range(0x4E00, 0x4E00 + 2000)))
TEXTS = {"han": unspaced(HAN, 3000, 1), "base64": unspaced("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3000, 2),
         "astral": unspaced("".join(map(chr, range(0x20000, 0x20400))), 2000, 3), "words": " ".join(unspaced("abcdefgh", 6, i) for i in range(3000))}


@pytest.mark.parametrize("name", TEXTS)
def test_one_character_more_changes_little(spark, name):
    text = TEXTS[name]
    for at in (0, 1, len(text) // 3, len(text)):
        assert near(spark, text, text[:at] + "Q" + text[at:]) >= 0.9


def test_more_edits_are_less_alike_and_order_counts(spark):
    text = TEXTS["han"]
    some, many = (near(spark, text, "".join("#" if i % step == 0 else c for i, c in enumerate(text))) for step in (100, 10))
    assert many < some < 1
    pieces = [text[i:i + 60] for i in range(0, 3000, 60)]
    assert near(spark, text, "".join(random.Random(5).sample(pieces, len(pieces)))) < 0.75
    assert near(spark, text, unspaced(HAN, 3000, 9)) < 0.05
