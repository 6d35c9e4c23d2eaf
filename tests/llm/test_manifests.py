"""Exact dedup by tries, Merkle manifest, source divergence: against plain versions, odd rows included."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import merkle_manifest, shared, source_divergence, trie_dedup


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    shared.ship(spark)


# ---- tries


def check_owners(spark, rows, keep="smallest", **options):
    got = trie_dedup.owners(brute.documents(spark, rows), keep=keep, **options).collect()
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == \
        brute.owners(rows, keep)
    stay = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(stay.values()) <= {1} and set(stay) == {r["text_sha256"] for r in got}
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


ODD = [(5, "a"), (3, "a"), (3, "a"), (None, "a"), (None, "b"), (None, "b"), (1, None), (2, ""), (4, " "), (6, "A"),
       (7, "é" * 40), (8, "é" * 40), (9, "x" * 300_000), (10, "x" * 300_000), (11, "x" * 299_999 + "y"), (12, "a\n")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_owners_of_odd_rows(spark, keep):
    check_owners(spark, ODD, keep)


def test_owners_of_nothing(spark):
    assert trie_dedup.owners(brute.documents(spark, [])).collect() == []


@pytest.mark.parametrize("budget", [8_000, 40_000])
def test_owners_when_tries_spill(spark, budget):
    """Prefixes in common, many texts of one length, one text in half of all rows."""
    rng = random.Random(budget)
    texts = [f"{'common beginning ' * rng.randrange(3)}{rng.randrange(150):03d}{'tail' * rng.randrange(2)}" for _ in range(300)]
    rows = [(rng.randrange(1000), rng.choice(texts) if rng.random() < 0.5 else "hot text") for _ in range(900)]
    check_owners(spark, rows, "largest", budget=budget)


def test_trie_shares_prefixes_and_parts_subtrees():
    trie = trie_dedup.Trie()
    texts = [b"abcd", b"abxy", b"abxz", b"qrst", b""]
    found = {t: trie.find(t) for t in texts}
    assert all(trie.find(t) is n for t, n in found.items()) and trie.texts == 5
    assert sorted(t for t, _ in trie.terminals()) == sorted(texts)
    assert trie.bytes == len(b"abcd" b"xy" b"z" b"qrst") + 5 * trie_dedup.NODE_BYTES
    prefix, node = trie.heaviest()
    assert prefix == b"" and {t for t, _ in trie.terminals(node, prefix)} == {b"abcd", b"abxy", b"abxz"}
    trie.spill(node, 9)
    assert trie.find(b"abcd").branch == 9 and trie.find(b"abnew").branch == 9 and trie.find(b"qrst").branch is None
    assert trie.texts == 2


def test_trie_keeps_the_way_to_what_it_spilled_before():
    trie = trie_dedup.Trie()
    for t in (b"ab1", b"ab2", b"ac3", b"d"):
        trie.find(t)
    trie.spill(trie.root.children[b"a"].children[b"b"], 1)
    trie.spill(trie.root.children[b"a"], 2)
    assert [trie.find(t).branch for t in (b"ab1", b"ab9", b"ac3", b"d")] == [1, 1, 2, None]
    assert trie.texts == 1


# ---- Merkle manifest


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_van_emde_boas_order(fanout):
    for levels in range(1, 7 if fanout < 5 else 5):
        places = [a for d in range(levels) for a in merkle_manifest.addresses(levels, d, fanout)]
        assert sorted(places) == list(range(merkle_manifest.node_count(levels, fanout)))
    # four levels: the top two first, then each bottom of two in one stretch
    at = [merkle_manifest.addresses(4, d, 3) for d in range(4)]
    assert at[0] == [0] and at[1] == [1, 2, 3] and at[2][:2] == [4, 8] and at[3][:3] == [5, 6, 7]


def leaves(spark, rows):
    return spark.createDataFrame(rows, "source string, id long, digest string, altered string").withColumns(
        {name: F.lit("x") for name in ("tree", "pos", "n", "block", "root", "leaf")})


def check_manifest(spark, rows, **options):
    frame = leaves(spark, rows).select("source", "id", "digest", "altered")
    got = merkle_manifest.audit(frame.repartition(3), **options).collect()
    names = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == brute.merkle(rows, options.get("fanout", 3))


@pytest.mark.parametrize("options", [{"height": 1}, {"height": 2}, {"height": 2, "fanout": 2}, {}])
def test_manifest_of_sources_of_all_sizes(spark, options):
    rng = random.Random(5)
    rows = []
    for source, n in ((None, 1), ("", 2), ("a", 3), ("b", 4), ("é", 9), ("Z", 10), ("hot", 100), ("z", 27)):
        for i in rng.sample(range(1000), n):
            digest = brute.H(source or "-", str(i))
            rows.append((source, i, digest, brute.H(digest) if i % 2 else None))
    rng.shuffle(rows)
    check_manifest(spark, rows, **options)


def test_manifest_of_odd_rows(spark):
    one = [("s", 1, brute.H("1"), brute.H("other"))]
    check_manifest(spark, one)
    repeated = [("s", 4, brute.H("x"), None), ("s", 4, brute.H("x"), None), ("s", 4, brute.H("y"), None),
                ("s", None, brute.H("z"), None), ("s", None, brute.H("a"), None), (None, None, brute.H("q"), None)]
    check_manifest(spark, repeated, height=1)
    assert merkle_manifest.audit(leaves(spark, []).select("source", "id", "digest", "altered")).collect() == []


def test_leaf_frames_its_fields(spark):
    rows = spark.createDataFrame([(1, "é\n", None), (12, "", "x")], "a long, b string, c string")
    got = rows.select(merkle_manifest.leaf_digest(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()
    assert [r["h"] for r in got] == [brute.H("1:1", "3:é\n", "-"), brute.H("2:12", "0:", "1:x")]


# ---- divergence


def check_divergence(spark, rows, **options):
    full = [(i, *r) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string").withColumns(
        {name: F.lit("x") for name in ("term", "n", "block", "tile", "base", "value", "item")})
    got = source_divergence.audit(docs.repartition(3), **options).collect()
    names = ("lang", "source", "part", "item", "value", "rank")
    assert sorted(tuple(r[n] for n in names) for r in got) == brute.divergence(
        rows, options.get("least_docs", 3), options.get("top", 200))


@pytest.mark.parametrize("options", [{}, {"tile": 1}, {"tile": 2, "top": 3}, {"least_docs": 1}])
def test_divergence_of_prose(spark, options):
    rng = random.Random(2)
    rows = []
    for _ in range(160):
        lang = rng.choice(["en", "de", None])
        words = [f"{lang}{chr(97 + int(rng.expovariate(0.2)) % 26)}" for _ in range(rng.randrange(30))]
        rows.append((" ".join(words), lang, rng.choice(["s1", "s1", "s2", "s3", None, "é"])))
    check_divergence(spark, rows, **options)


def test_divergence_of_odd_rows(spark):
    rows = [("ÉA éa ÉA-b1C", "en", "a"), ("éa c", "en", "a"), ("ÉA c\tb\x00c", "en", "b"), ("x" * 100_000, "en", "b"),
            (None, "en", "c"), ("123 +-", "en", ""), ("alone", "fr", "a"), ("", "fr", "b"), (None, None, None),
            ("éa c", "en", "a"), ("éa c", "en", "a")]
    check_divergence(spark, rows)
    check_divergence(spark, [("alone", "fr", "a")])
    assert source_divergence.audit(brute.documents(spark, [])).collect() == []


def test_gallop_finds_all_that_both_hold():
    rng = np.random.default_rng(4)
    for few, many in ((0, 9), (5, 0), (3, 4000), (2000, 2100), (1500, 9000)):
        a, b = (np.unique(rng.integers(0, 10_000, n)) for n in (few, many))
        x, y = source_divergence.gallop(a, b, stride=64)
        assert a[x].tolist() == np.intersect1d(a, b).tolist() == b[y].tolist()


def test_rates_beyond_64_bits():
    counts = np.array([0, 3, 10 ** 13])
    assert source_divergence.rates(counts, 10 ** 14).tolist() == [1 + 10 ** 9 * (c + 1) // 10 ** 14 for c in counts.tolist()]
