"""Exact duplicates, periodic runs and the source audit against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm import chunk_recipes, queries, source_divergence, word_runs

SCHEMA = "doc_id long, text string, lang string, source string, key string, row int, block int, total int, recipe int, n int"
SF = "/root/testdata/sf0.001"


def prose(rng, n, size=60):
    return " ".join(rng.choice("alpha beta gamma Delta kappa omega sigma tau rho phi chi psi".split()) + "abcdefghij"[rng.randrange(10)] * rng.randrange(size // 10) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base, long = prose(rng, 900), prose(rng, 6000)
    texts = [base, base.replace(" ", "\n\t "), base + " ", " " + base, base[:-1], None, "", " ", "\n\n", long, long, long[:30000] + "x" + long[30001:], "語" * 9000, "語" * 9000 + " ",
             "a" * 20000, "a " * 700, "a b " * 40, "x y z x y z x y z x y z q", prose(rng, 200) + " loop over again" * 9 + " " + prose(rng, 50), "one two", "É é A a ſ İ \x85 b\xa0c", "𝄞" * 700]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}") for i, t in enumerate(texts)]
    out += [(i, prose(rng, 80), "de", f"s{rng.randrange(5)}") for i in range(100, 150)] + [(i, prose(rng, 60), "en", "s0" if rng.random() < 0.5 else None) for i in range(200, 240)]
    out += [(7, base, "en", "s1"), (7, base, "en", "s1"), (None, base, "fr", "lone"), (None, None, "xx", "a"), (None, "null ids only", "xx", "b"), (None, "null ids only", "xx", "b")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------ exact duplicates
def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    return Counter((i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(docs, rows, bits):
    got = chunk_recipes.exact_duplicates(docs, "doc_id", "text", bits).collect()
    assert Counter((r["key"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected_groups(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})  # one row a group, repeated ids too
    assert all(r["key"] == r["keep_id"] for r in kept)


def test_names_are_verified(docs):
    cut = docs.select(chunk_recipes.chunks(chunk_recipes.normalised(F.col("text"))).alias("pieces"))
    assert chunk_recipes.shared_names(cut).isEmpty()
    assert chunk_recipes.shared_names(cut, 2).count() > 0


def test_chunks_are_the_text_and_follow_content(docs, rows):
    cut = docs.select("text", chunk_recipes.chunks(chunk_recipes.normalised(F.col("text"))).alias("pieces")).collect()
    for r in cut:
        assert "".join(r["pieces"]) == norm(r["text"]) and all(0 < len(c) <= chunk_recipes.MAX_CHARS for c in r["pieces"])
    pieces = [r["pieces"] for r in cut if r["text"] is not None and len(r["text"]) > 30000 and r["text"][0].isalpha()]
    near = [set(p) for p in pieces]
    assert len(near[0] & near[2]) > 0.8 * len(near[0]) and len(near[0]) > 20  # one changed character changes one or two chunks


def test_exact_duplicates_of_nothing(none):
    assert chunk_recipes.exact_duplicates(none, "doc_id", "text").collect() == []


def test_op11_registered(spark):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
        want = con.sql(queries.ORACLES["op11_chunk_recipes"]).fetchall()
    assert Counter(map(tuple, queries.QUERIES["op11_chunk_recipes"](spark, SF).collect())) == Counter(want)


# ---------------------------------------------------------------- periodic runs
def brute_runs(words):
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(word_runs.MIN_RUN, 2 * p) and not any(p % q == 0 and s <= i and j + p <= s + m for s, m, q in found):
                found.append((i, j + p - i, p))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in drop)


def random_words(rng):
    out = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.choice("abcd"[:rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 9))]
        out += (unit * 12)[:rng.randrange(0, 12 * len(unit))] if rng.random() < 0.6 else [rng.choice("abcdefgh") for _ in range(rng.randrange(30))]
    return [w.encode() for w in out]


def test_runs_against_all_lags():
    rng = random.Random(3)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 5))]
        for words, runs in zip(texts, word_runs.text_runs(texts), strict=True):
            assert runs == brute_runs(words)
            assert word_runs.collapse(words, runs) == brute_collapse(words, runs)


def test_long_segments_use_the_same_probes(monkeypatch):
    rng = random.Random(5)
    texts = [random_words(rng) + random_words(rng) for _ in range(60)]
    want = word_runs.text_runs(texts)
    monkeypatch.setattr(word_runs, "SHARED_WORDS", 16)
    monkeypatch.setattr(word_runs, "PROBES", 64)
    word_runs.shared_probes.cache_clear()
    assert word_runs.text_runs(texts) == want
    word_runs.shared_probes.cache_clear()


def test_long_runs():
    unit = [str(i).encode() for i in range(9000)]
    assert word_runs.text_runs([unit * 3 + [b"end"]]) == [[(0, 27000, 9000)]]
    assert word_runs.text_runs([[b"a"] * 60000]) == [[(0, 60000, 1)]]


def test_rare_words_split():
    words = np.array([0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 9, 2, 2, 2, 3, 3, 3, 7, 2, 3] + list(range(20, 40)))
    assert word_runs.surviving_segments(words, np.array([0, len(words)])).tolist() == [[0, 12]]


def test_find_runs(docs, rows, none):
    got = Counter((r["key"], r["n_words"], tuple(map(tuple, r["runs"])), bytes(r["collapsed"])) for r in word_runs.find_runs(docs, "doc_id", "text").collect())
    want = Counter()
    for r in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode())
        runs = brute_runs(words) if len(words) < 3000 else word_runs.text_runs([words])[0]
        want[r[0], len(words), tuple(runs), brute_collapse(words, runs)] += 1
    assert got == want
    assert word_runs.find_runs(none, "doc_id", "text").isEmpty()


def test_op12_registered(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    planted = longest = 0
    for r in queries.QUERIES["op12_word_runs"](spark, SF).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], planted + 1
        words = [w.encode() for w in words]
        runs = brute_runs(words) if n < 1200 else word_runs.text_runs([words])[0]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        longest = max(longest, best[1] or 0)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapse(words, runs)).hexdigest()
    assert planted > 5 and longest > 100


# ----------------------------------------------------------------- source audit
def brute_audit(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tf, df, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        tf[lang, source].update(found)
        df[lang].update(set(found))
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]

        def shares(count):
            d = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // d for t in kept}

        p = {s: shares(tf[lang, s]) for s in names}
        whole = shares(sum((tf[lang, s] for s in names), Counter()))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in names:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in names - {s}]
            terms = [(-f(p[s][t], whole[t]), t.encode(), t) for t in kept if tf[lang, s][t] and p[s][t] > whole[t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("block, held", [(4096, 200_000), (3, 5)])
def test_audit(docs, rows, monkeypatch, block, held):
    monkeypatch.setattr(source_divergence, "BLOCK_VECTORS", block)
    monkeypatch.setattr(source_divergence, "HELD_TERMS", held)
    for least in (1, 10):
        got = source_divergence.audit(docs, "text", "lang", "source", least, 5).select("lang", "source", "part", "item", "value", "rank")
        assert Counter(map(tuple, got.collect())) == brute_audit(rows, least, 5)


def test_audit_of_nothing(none):
    got = source_divergence.audit(none, "text", "lang", "source")
    assert got.collect() == [] and got.schema["value"].dataType == T.LongType()


def test_run_borders_are_intersected():
    columns = [np.array(c) for c in ([5, 5, 5, 2, 2], [5, 5, 1, 1, 2], [7, 7, 7, 7, 7])]
    sizes = np.array([3, 1, 4, 1, 5])
    want = [[sum((x - y) ** 2 // (x + y) * n for x, y, n in zip(a, b, sizes)) for b in columns] for a in columns]
    assert source_divergence.block_pairs(columns, sizes) == want


def test_shares_are_exact(spark):
    got = spark.createDataFrame([(10**12, 3 * 10**12, 10**7), (0, 1, 1)], "c long, n long, v long").select(source_divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (10**12 + 2) // (3 * 10**12 + 2 * 10**7), 1 + 2 * 10**9 // 3]
