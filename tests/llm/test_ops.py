"""Each operator against its plain version, with the cases that must not break it."""

import math
import random
from array import array

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import (
    components,
    cube_mix,
    host_reputation,
    license_index,
    line_dedup,
    shared,
    simhash_decontam,
    tensor_minhash,
    token_store,
    toxicity,
    vafile,
    warc,
)

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    shared.ship(spark)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- near-duplicates


def copies_of(rng, text, n, edits):
    out = []
    for _ in range(n):
        words = text.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


def check_duplicates(spark, rows):
    got = tensor_minhash.duplicates(brute.documents(spark, rows)).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == \
        brute.near_duplicates(rows)
    assert all(r["kept"] == (r["id"] is None or r["id"] == r["component_id"]) for r in got)


def test_duplicates_of_groups_and_chains(spark):
    rng = random.Random(3)
    rows, chain = [], prose(rng, 120)
    for n in (40, 25, 9):
        base = prose(rng, rng.choice((60, 200, 900)))
        rows += [(len(rows) + i, t) for i, t in enumerate(copies_of(rng, base, n, 2))]
    for _ in range(30):  # each like the one before, the ends unlike
        rows.append((len(rows), chain))
        chain = copies_of(rng, chain, 1, 2)[0]
    shared_part = prose(rng, 40)
    rows += [(len(rows) + i, f"{shared_part} {prose(rng, 80)}") for i in range(40)]
    rng.shuffle(rows)
    check_duplicates(spark, rows)


def test_duplicates_of_odd_rows(spark):
    text = "One two three four five six seven"
    rows = [(5, text), (2, text.upper()), (2, text), (9, None), (8, ""), (7, " \n\t"), (6, "one two"), (4, "One\vTWO"),
            (None, text), (None, None), (11, "é " * 30), (12, "É " * 30), (20, "long " * 40_000), (19, "long " * 40_001)]
    check_duplicates(spark, rows)


def test_duplicates_of_nothing(spark):
    assert tensor_minhash.duplicates(brute.documents(spark, [])).count() == 0


def test_tensor_of_half_keys():
    hashes = tensor_minhash.Hashes(4, 2, 1)
    one = tensor_minhash.shingles("a b c d e f g h")
    assert hashes.half_keys(one).shape == (2, 4)
    assert (hashes.half_keys(one) == hashes.half_keys(one[::-1])).all()
    assert len(set(hashes.half_keys(one).ravel().tolist())) == 8


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, 1500)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {2000: 1500}


# ---- decontamination


def test_contamination_finds_copies_and_edits(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice((14, 30, 59)))) for i in range(30)]
    items += [(100, "Only three words"), (101, ""), (102, None), (None, prose(rng, 20)), (3, items[3][1])]
    rows = []
    for i, (_, item) in enumerate(items[:30]):
        body, edited = prose(rng, 70), item.split()
        if i % 3 == 1:
            edited[0] = "changed"  # the rest of its shingles stay
        if i % 3 == 2:
            edited = edited[: len(edited) // 2]
        rows.append((i, f"{body} {' '.join(edited).upper()}, {prose(rng, 50)}"))
    rows += [(50, "before only THREE words after"), (51, None), (52, ""), (None, items[0][1]), (0, rows[0][1]),
             (60, prose(rng, 50_000) + " " + items[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("length", F.lit("clash"))
    got = {(r["id"], r["item"]): r for r in simhash_decontam.contamination(brute.documents(spark, rows), bench).collect()}
    wanted = {(d, i) for d, t in rows if d is not None for i, item in items
              if i is not None and brute.item_similarity(t, item) >= 0.75}
    assert set(got) == wanted and (60, 7) in wanted and (50, 100) in wanted and (2, 2) not in wanted
    assert got[60, 7]["start"] == 50_000 and got[60, 7]["common"] == got[60, 7]["total"]


def test_contamination_beyond_the_broadcast_bound_is_the_same(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, 25)) for i in range(12)]
    rows = [(i, f"{prose(rng, 30)} {items[i % 12][1]}") for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = brute.documents(spark, rows)
    one = sorted(map(tuple, simhash_decontam.contamination(docs, bench).collect()))
    assert one and one == sorted(map(tuple, simhash_decontam.contamination(docs, bench, broadcast_rows=0).collect()))


def test_contamination_of_nothing(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = brute.documents(spark, [(1, "a b c d e f")])
    assert simhash_decontam.contamination(docs.limit(0), bench).count() == 0
    assert simhash_decontam.contamination(docs, bench.limit(0)).count() == 0


def test_contamination_of_items_that_share_boilerplate(spark):
    """Shared shingles weigh little: pairs above 0.75 that few or many shingles in common make up."""
    rng = random.Random(8)
    rules, options = prose(rng, 24), prose(rng, 80)
    cut = [(i, f"{prose(rng, 29)} {rules}") for i in range(70)]  # its documents end before the rules
    swapped = [(i, f"{prose(rng, 3)} {options}") for i in range(70, 100)]  # theirs begin otherwise
    items = cut + swapped
    rows = [(i, f"{prose(rng, 12)} {' '.join(t.split()[:29])}") for i, t in cut]
    rows += [(i, f"{prose(rng, 12)} {prose(rng, 3)} {options} {prose(rng, 12)}") for i, _ in swapped]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item"]): r["common"] / r["total"] for r in simhash_decontam.contamination(
        brute.documents(spark, rows), bench).collect()}
    wanted = {(d, i): s for d, t in rows for i, s in brute.weighted_similarities(t, items).items() if s >= 0.75}
    assert {(i, i) for i, _ in cut} <= set(wanted)
    missed = set(wanted) - set(got)
    assert len(missed) <= 0.01 * len(wanted) and len([d for d, i in missed if d == i < 70]) <= 2
    assert not set(got) - set(wanted) and all(abs(wanted[pair] - s) < 1e-3 for pair, s in got.items())


def test_contamination_when_the_best_window_begins_with_the_words_of_others(spark):
    """Item 0 shares four opening words with longer items that begin with twelve of them."""
    rng = random.Random(12)
    opening = [f"open{i}" for i in range(12)]
    own = [f"own{i}" for i in range(44)]
    items = [(0, " ".join(opening[8:] + own))]
    items += [(i, " ".join(opening + [f"item{i}x{k}" for k in range(60)])) for i in range(1, 400)]
    rows = [(c, " ".join(opening + own[:c] + [f"foreign{c}x{k}" for k in range(60)])) for c in (35, 36, 37, 38, 40, 44)]
    rng.shuffle(rows)
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), brute.documents(spark, rows)
    wanted = {(d, i): s for d, t in rows for i, s in brute.weighted_similarities(t, items).items() if s >= 0.75}
    assert {(c, 0) for c in (35, 36, 37, 38, 40, 44)} <= set(wanted)
    for options in ({}, {"broadcast_rows": 0}):
        got = {(r["id"], r["item"]): r["common"] / r["total"]
               for r in simhash_decontam.contamination(docs, bench, **options).collect()}
        assert set(got) == set(wanted) and all(abs(wanted[pair] - s) < 1e-3 for pair, s in got.items())


def test_simhash_and_its_index(spark):
    rng = random.Random(1)
    lists = [[rng.getrandbits(63) - (1 << 62) for _ in range(n)] for n in (1, 7, 40, 300)]
    got = spark.createDataFrame([(x,) for x in lists], "x array<long>").select(simhash_decontam.simhash(F.col("x"))).collect()
    for shingles, row in zip(lists, got):
        bits = [sum(s >> b & 1 for s in shingles) * 2 >= len(shingles) for b in range(64)]
        assert row[0] & ((1 << 64) - 1) == sum(1 << b for b in range(64) if bits[b])
    base = rng.getrandbits(63)
    prints = [base]
    for distance in range(0, 20):
        flipped = base
        for bit in rng.sample(range(64), distance):
            flipped ^= 1 << bit
        prints.append(flipped - (1 << 64) if flipped >= 1 << 63 else flipped)
    items = spark.createDataFrame([(1, 30, base)], "item long, length int, print long")
    probes = spark.createDataFrame([(p,) for p in prints], "p long").select("p", F.explode(
        simhash_decontam.block_values(F.col("p"), 5)).alias("b")).select("p", "b.block", "b.value")
    met = probes.join(simhash_decontam.entered(items, 5, 19), ["block", "value"]).select("p").distinct()
    assert met.count() == len(set(prints))


# ---- line dedup


def test_line_dedup_against_plain(spark):
    rng = random.Random(2)
    common = ["  A line that many documents hold\t", "a LINE that many documents hold", "short", "é" * 20, "x" * 19,
              "another line of twenty and more", "\x0bvertical white space counts too\r"]
    rows = [(i, "\n".join(rng.choice([*common, prose(rng, 6), ""]) for _ in range(rng.randrange(1, 90)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (None, common[0] + "\n" + common[0]), (1, common[5]), (1, rows[1][1]),
             (73, "\n".join([common[5]] * 5000))]
    got = line_dedup.dedup(brute.documents(spark, rows)).collect()
    assert sorted(((r["id"], r["n_lines"], r["n_dropped"], list(r["kept"])) for r in got), key=repr) == \
        sorted(brute.line_dedup(rows), key=repr)


def test_line_bitmaps_are_sparse(spark):
    line = "the same line in three documents"
    docs = brute.documents(spark, [(1, "\n" * 200 + line), (2, line), (3, line), (4, "other")])
    got = {r["id"]: (r["n_dropped"], r["dropped"]) for r in line_dedup.bitmaps(docs).collect()}
    assert got == {1: (1, {3: 1 << 8}), 2: (1, {0: 1})}
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_line_places_are_exchanged_once(spark, monkeypatch):
    """Range partitions carry the result: words and first occurrences need no exchange of their own."""
    plans = []

    def keep(frame, path):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return written(frame, path)

    written = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", keep)
    docs = brute.documents(spark, [(i, "a line that many documents hold\n" * 3) for i in range(5)])
    got = {r["id"]: r["n_dropped"] for r in line_dedup.bitmaps(docs).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3}
    words = plans[0]
    assert words.count("Exchange") == words.count("Exchange rangepartitioning(h1") == 1
    assert "Window [row_number()" in words


# ---- cube mix


@pytest.mark.parametrize("bucket_rows", [4000, 12])
def test_mix_meets_targets(spark, bucket_rows):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice((1, 5, 30, 200))), rng.choice(["a", "b", "é", "Z", None, "a"])) for i in range(600)]
    rows += [(700, None, "a"), (701, "", "empty"), (1, rows[1][1], rows[1][2]), (None, "no id here", "b"),
             (702, "word " * (20_000 if bucket_rows > 12 else 900), "a")]
    size, target = brute.targets(rows)
    got = cube_mix.mix(brute.documents(spark, rows), bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    taken = dict.fromkeys(size, 0)
    for r in got:
        assert 0 <= r["copies"] <= 2 and r["source_size"] == size[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        taken[r["source"]] += r["copies"] * r["size"]
    for source, words in taken.items():
        near = 0.01 if bucket_rows > 12 else 0.03  # the last bucket has few to choose from
        assert abs(words - target[source]) <= near * target[source] + 5
    assert math.isclose(sum(target.values()), 1.5 * sum(size.values()))
    again = cube_mix.mix(brute.documents(spark, rows).repartition(7, "text"), bucket_rows=bucket_rows).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_of_nothing(spark):
    assert cube_mix.mix(brute.documents(spark, [])).count() == 0
    assert [r["copies"] for r in cube_mix.mix(brute.documents(spark, [(1, None, None)])).collect()] == [0]


def test_flight_keeps_totals():
    rng = random.Random(8)
    size = sorted((float(rng.choice((1, 3, 3, 10, 77))) for _ in range(200)), reverse=True)
    chance = [0.37] * 200
    moved = cube_mix.flight(chance, size, [rng.random() for _ in size])
    assert sum(0 < p < 1 for p in moved) <= 2
    assert math.isclose(sum(moved), sum(chance), rel_tol=1e-9)
    assert math.isclose(sum(p * s for p, s in zip(moved, size)), sum(p * s for p, s in zip(chance, size)), rel_tol=1e-9)


def test_flight_is_unbiased():
    rng = random.Random(9)
    runs = [cube_mix.flight([0.3] * 9, [9.0, 7, 6, 5, 4, 3, 2, 1.5, 1], [rng.random() for _ in range(9)]) for _ in range(4000)]
    assert np.allclose(np.mean(runs, axis=0), 0.3, atol=0.03)


# ---- license index

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def test_license_places_against_plain(spark):
    rng = random.Random(7)
    pieces = ["MIT License", "mit  license", "Apache-License,", "GNU General Public License, version 3", "license", "mit",
              "general", "public license", "permission is hereby granted, free of charge", "All rights reserved.", "é", "K"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "mit license"), (None, "MIT LICENSE mit license"), (92, "mit license"),
             (93, "filler " * 30_000 + "apache license")]
    base = [t.name for t in license_index.BASE]
    got = license_index.scan(brute.documents(spark, rows)).collect()
    found = sorted(((r["doc_id"], r["n_words"], *summary(r["matches"], base)) for r in got), key=repr)
    assert found == sorted(((d, *brute.license_places(t, PHRASES)) for d, t in rows), key=repr)
    assert license_index.scan(brute.documents(spark, [])).count() == 0


def summary(matches, base):
    own = [m for m in matches if m["template"] in base]
    starts = [m["start"] for m in own]
    return len(own), min(starts, default=None), max(starts, default=None), ",".join(sorted({m["label"] for m in own}))


def test_license_templates_need_their_phrase(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "licensed under the apache version 2 0"),
            (3, "under the apache license version 2 0"), (4, "CC BY-NC")]
    got = {r["doc_id"]: {m["template"]: m["score"] for m in r["matches"]}
           for r in license_index.scan(brute.documents(spark, rows)).collect()}
    assert got[1]["apache-notice"] == 1.0 and got[2] == {} and got[3]["apache-notice"] == 7 / 8
    assert got[4]["cc-by-nc-notice"] == 3 / 7


# ---- host reputation


def test_urls(spark):
    urls = ["http://A.Org/x?y#z", "https://a.org", "//a.org/", None, "", "a://b://c/d", "http://h.org?q", "http://h.org#f/",
            "http://h\n.org/p\nq?r", "http://ÄB.com/É"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in frame.select(host_reputation.host_of(F.col("url")), host_reputation.path_of(F.col("url"))).collect()]
    assert got == [("a.org", "/x"), ("a.org", ""), ("", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("h.org", ""), ("h.org", ""),
                   ("h\n.org", "/p\nq"), ("Äb.com", "/É")]


def test_reputation_shrinks(spark):
    hosts = [("bad.x.com", 1, 40), ("good.x.com", 0, 40), ("few.bad.com", 1, 1), ("y.bad.com", 1, 60), ("new.bad.com", None, 3),
             ("solo.org", None, 2), ("", None, 1), (None, None, 1)]
    rows = [(h, b) for h, b, n in hosts for _ in range(n)]
    got = {r["host"]: r for r in host_reputation.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert set(got) == {h or "" for h, _, _ in hosts}
    assert got["good.x.com"]["mean"] < 0.1 < 0.9 < got["bad.x.com"]["mean"]
    assert got["y.bad.com"]["mean"] >= got["new.bad.com"]["mean"] > got["solo.org"]["mean"]
    assert got["few.bad.com"]["deviation"] > got["y.bad.com"]["deviation"]
    assert all(0 <= r["mean"] <= 1 and r["bad"] + r["good"] >= 0 for r in got.values())


@pytest.mark.parametrize("pages", [1, 3])
def test_hosts_of_equal_chances_are_shrunk_to_one_rate(spark, pages):
    """Every page is blocked with the same chance: a host of few pages says nothing about itself."""
    rng = random.Random(pages)
    rows = [(f"h{i}.com", int(rng.random() < 0.3)) for i in range(3000) for _ in range(pages)]
    got = host_reputation.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()
    assert len(got) == 3000 and all(abs(r["mean"] - 0.3) < 0.1 for r in got)
    assert all(r["mean"] - 1.645 * r["deviation"] < 0.5 for r in got)


def test_hosts_that_differ_keep_their_rates(spark):
    rng = random.Random(6)
    rows = [(f"h{i}.com", int(rng.random() < (0.95 if i % 2 else 0.05))) for i in range(300) for _ in range(20)]
    got = host_reputation.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()
    assert all((r["mean"] > 0.6) == bool(int(r["host"][1:-4]) % 2) for r in got)


def test_suffixes_of_two_labels(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "uk", "a.b.com", "x.notco.uk", "", "a."]
    suffix = host_reputation.suffix_of(F.col("host"))
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select(
        suffix, host_reputation.domain_of(F.col("host"), suffix)).collect()
    assert [tuple(r) for r in got] == [("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("uk", "uk"),
                                       ("com", "b.com"), ("uk", "notco.uk"), ("", ""), ("", "a.")]


def test_judge(spark):
    rules = [host_reputation.UrlRule("block", "bad.com"), host_reputation.UrlRule("allow", "com", "/ok/"),
             host_reputation.UrlRule("allow", "ok.bad.com"), host_reputation.UrlRule("allow", "org")]
    rows = [(1, "http://bad.com/a"), (2, "http://x.bad.com/ok/1"), (3, "http://notbad.com/a"), (4, "http://ok.bad.com/"),
            (5, None), (6, "http://bad.com"), (None, "http://bad.com/b"), (1, "http://bad.com/a")]
    rows += [(100 + i, f"http://bad.com/{i}") for i in range(30)] + [(200 + i, "http://good.org/ok/") for i in range(99)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("x"), "rule": F.lit(1)})
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in host_reputation.judge(pages, rules).collect()]
    assert len(got) == len(rows) and got.count((1, "bad.com/", "block")) == 2
    assert (2, "bad.com/", "block") in got and (4, "ok.bad.com/", "allow") in got and (5, None, "allow") in got
    assert (3, None, "block") in got and (6, None, "block") in got  # its host's pages are blocked
    assert host_reputation.judge(pages.limit(0), rules).count() == 0


# ---- vector search


def plain_top(rows, scale, k):
    whole = [(i, None if v is None or any(x is None or not math.isfinite(x) for x in v)
              else [math.floor(scale * x) for x in v]) for i, v in rows]
    usable = [(i, v) for i, v in whole if i is not None and v is not None]
    out = []
    for q in sorted({i for i, _ in usable if i % 10 == 0}):
        query = min(v for i, v in usable if i == q)
        scored = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in usable if i != q and len(v) == len(query))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("bits", [8, 2])
def test_vafile_against_plain(spark, bits):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(15)]  # ties
    rows += [(500, None), (501, [1.0, None] * 6), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (None, rows[1][1]),
             (5, rows[5][1]), (10, rows[10][1]), (600, [0.5, 0.5]), (601, [1.0, -1.0]), (610, []), (611, []), (700, [3e5] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "dim": F.lit(0)})
    got = vafile.top_k(frame, F.col("id") % 10 == 0, k=6, bits=bits, block_rows=40, query_rows=8).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 1024, 6)
    assert vafile.top_k(frame.limit(0), F.col("id") % 10 == 0).count() == 0


@pytest.mark.parametrize("sizes", [None, (1 << 12, 1 << 6)])
@pytest.mark.parametrize("scale", [1024, 40_000])
def test_vafile_lanes_and_copies(spark, monkeypatch, sizes, scale):
    for name, size in zip(("LANE_BYTES", "PART_BYTES"), sizes or ()):
        monkeypatch.setattr(vafile, name, size)
    rng = random.Random(12)
    near, same = ([rng.gauss(0, 0.3) for _ in range(6)] for _ in range(2))
    rows = [(3 * i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(700)]
    rows += [(3 * i + 1, [x + rng.gauss(0, 0.002) for x in near]) for i in range(500)]
    rows += [(5 * i, same) for i in range(200)]
    rows += [(i, same) for i in (0, 10, 20) for _ in range(9)]  # repeated rows, more than k of them
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vafile.top_k(frame, F.col("id") % 10 == 0, k=6, scale=scale, block_rows=40, query_rows=16).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, scale, 6)


def test_vafile_blocks_are_not_paired_in_rows(spark):
    """Vectors go to their lane once: no row holds a block of them beside a block of queries."""
    def outputs(plan):
        columns = plan.output()
        yield {columns.apply(i).name() for i in range(columns.size())}
        for i in range(plan.children().size()):
            yield from outputs(plan.children().apply(i))
    frame = spark.createDataFrame([(i, [i / 7, 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    found = vafile.top_k(frame, F.col("id") % 10 == 0, k=2, block_rows=8, query_rows=2)
    rows = list(outputs(found._jdf.queryExecution().analyzed()))
    assert any("cells" in names for names in rows) and any("query" in names for names in rows)
    assert not any({"cells", "query"} <= names for names in rows)


def test_vafile_keeps_copies_that_a_result_can_hold():
    exact = np.array([[1, 2]] * 8 + [[3, 4]] * 2, dtype=np.int16)
    lane = vafile.lane_of([(np.array([9, 5, 5, 5, 7, 8, 5, 6, 2, 1]), np.zeros((10, 2), np.uint8), exact)], 2)
    assert lane.ids.tolist() == [1, 2, 5, 5, 6, 7] and lane.exact[:, 0].tolist() == [3, 3, 1, 1, 1, 1]


def test_vafile_bounds_hold():
    rng = np.random.default_rng(0)
    exact = rng.integers(-500, 500, (200, 8))
    low, high = exact.min(axis=0), exact.max(axis=0)
    width = vafile.widths(low, high, 3)
    lower, upper = vafile.bounds(exact[:20], ((exact - low) // width).astype(np.uint8), low, width)
    products = exact[:20] @ exact.T
    assert (lower <= products).all() and (products <= upper).all()


# ---- WARC


def test_warc_round_trip(spark):
    rows = [(3, "<p>same</p>"), (1, "<p>same</p>"), (2, None), (5, ""), (4, "ümlaut \r\n\r\n WARC/1.1"), (None, "<p>same</p>"),
            (None, "alone"), (7, "x" * 3_000_000), (8, "<p>twice</p>"), (8, "<p>twice</p>")]
    rows += [(100 + i, "<p>same</p>") for i in range(60)]
    pages = spark.createDataFrame([(p, f"http://h/{p} \n", h, "x") for p, h in rows],
                                  "page_id long, url string, html string, digest string")
    mono, single = shared.scratch(spark, "test-mono"), shared.scratch(spark, "test-single")
    archives = warc.normalise(warc.write_monolithic(warc.planned(pages.repartition(3)), mono, archive_bytes=1000), single)
    got = warc.records(archives, single, with_payload=True).collect()
    keys = [(None if r["record_id"] == "urn:page:" else int(r["record_id"][9:]), r["payload_bytes"], r["payload_digest"],
             r["record_type"], None if r["refers_to"] is None else int(r["refers_to"][9:])) for r in got]
    assert sorted(keys, key=repr) == sorted(brute.warc_rows(rows), key=repr)
    assert all(r["verified"] for r in got if r["record_type"] == "response")
    texts = {p: (h or "").encode() for p, h in rows if p is not None}
    assert all(bytes(r["payload"]) == texts[k[0]] for r, k in zip(got, keys) if k[0] is not None and k[3] == "response")
    assert warc.normalise(warc.write_monolithic(warc.planned(pages.limit(0)), mono), single).count() == 0


def test_warc_truncated_is_an_error(tmp_path):
    import gzip
    whole = gzip.compress(warc.record_head("response", "urn:page:1", None, None, "2020-01-01T00:00:00Z", "D", 3, 3) + b"abc\r\n\r\n")
    for content, ends in ((whole, True), (whole[:-12], False)):
        path = tmp_path / "a.warc.gz"
        path.write_bytes(content)
        with open(path, "rb") as source:
            plain = warc.Inflated(source, "a")

            def read():
                head = plain.until(b"\r\n\r\n")
                size = int(warc._headers(head)["content-length"])
                return b"".join(plain.blocks(size + 4)), plain.until(b"\r\n\r\n")
            if ends:
                block, rest = read()
                assert block.endswith(b"abc\r\n\r\n") and rest is None
            else:
                with pytest.raises(ValueError, match="truncated"):
                    read()


# ---- token store

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path(TOKENIZER)


def test_token_store_round_trip(spark):
    path = tokenizer_path()
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(path)
    rng = random.Random(1)
    odd = ["", None, " ", "\n", "a  b", "a \n b\n\nc", "tab\there", "no\u00a0break \x1c x", "it's 12 o'clock!!", "<|endoftext|> x",
           "é à \U0001f600", "word\r\n\r\nword", " lead", "trail ", "\n\n\n x", "x" * 100_000, "many words " * 20_000]
    rows = [(i, t) for i, t in enumerate(odd)] + [(50 + i, prose(rng, 40)) for i in range(80)]
    rows += [(None, "no id"), (3, "second under an id"), (60, rows[30][1]), (60, rows[30][1])]
    folder = token_store.store_folder(spark)
    manifest = token_store.write(brute.documents(spark, rows).repartition(3), folder, path, shard_bytes=1500)
    assert manifest.count() > 3
    got = token_store.read(manifest, folder).collect()
    expected = [(d, plain.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]
    assert sorted(((r["doc_id"], r["n_ids"], r["ids_crc32"]) for r in got), key=repr) == \
        sorted(((d, len(ids), brute.crc_of(ids)) for d, ids in expected), key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_ids"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    shard = manifest.filter("n_docs > 0").orderBy("part", "seq").collect()[1]
    one = token_store._index(shared.opened_folder(folder)[0], shard["index"])[0]["doc_id"][0].as_py()
    found = token_store.read_document(folder, shard["data"], shard["index"], one)
    assert [list(f) for f in found][0] in [ids for d, ids in expected if d == one]


def test_token_store_learns_a_word_once():
    """Whatever marks stand around a word, the tokenizer gets it once; ids are those of whole texts."""
    path = tokenizer_path()
    words = [w for word in ("alpha", "größe", "слово") for w in (word, " " + word)]
    texts = [a + w + b for w in words for a in ("", ".", "(") for b in ("", ",", ";", ")", "'s", "-7", "!!")]
    one = token_store.Encoder(path, 0)
    assert one.encode(pa.array([*texts, None, ""]))[-2:] == [one.end] * 2
    letters = [p for p in one.known if any(c.isalpha() for c in p) and p != "'s"]
    assert sorted(letters) == sorted(words)


def test_token_store_cuts_where_the_tokenizer_cuts():
    path = tokenizer_path()
    from tokenizers import Tokenizer
    plain, rng = Tokenizer.from_file(path), random.Random(7)
    parts = [*"abZé ñßжΩ中あ한𝒜ªʰ", *"059½٣²", *".,!?-('\"_`~<|\x00\x7f", "'s", "'ll", "'T", "’s", "“", "…", "·", "×", "÷", "\u0301", "\u0903",
             "\u0387", "\u2028", "\U0001f600", "\ua7dc", " ", " ", " ", " ", "\n", "\n", "  ", "\n\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(6000)]
    texts += ["".join(rng.choices(parts, k=6)) + rng.choice(("\t", "\xa0", "<|endoftext|>", "\r\n")) + " a,b" for _ in range(300)]
    texts += [None, "", "x" * 5000, "中" * 300]
    rng.shuffle(texts)
    one = token_store.Encoder(path, 0)
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["cut off", *texts], kind).slice(1)
        got = [e for at in range(0, len(texts), 700) for e in one.encode(column.slice(at, 700))]
        for text, ids in zip(texts, got):
            assert ids == array("H", [*plain.encode(text or "", add_special_tokens=False).ids, 0]).tobytes(), text
    assert max(map(len, one.known)) <= token_store.CACHE_CHARS


def test_token_store_with_added_tokens_inside_words(tmp_path):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizer_path())
    plain.add_tokens(["pha", " be"])
    plain.save(str(tmp_path / "added.json"))
    texts = ["alpha", " alpha", "al", " beta", "beta", "alpha gamma", "a beta, gamma"]
    one = token_store.Encoder(str(tmp_path / "added.json"), 0)
    for ids, text in zip(one.encode(pa.array(texts)), texts):
        assert ids == one.packed([*plain.encode(text, add_special_tokens=False).ids, 0]), text


def test_token_store_keeps_right_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_PIECES", 2)
    one, column = token_store.Encoder(tokenizer_path(), 0), pa.array(["one two three", "four five", "one four"])
    first = one.encode(column)
    size = len(one.known)
    assert one.encode(column) == first and one.encode(pa.array(["six seven", "six"]))[1] == \
        array("H", [*one.tokenizer.encode("six").ids, 0]).tobytes()
    assert len(one.known) == size


def test_token_store_refuses_another_dictionary(spark):
    path, folder = tokenizer_path(), token_store.store_folder(spark)
    manifest = token_store.write(brute.documents(spark, [(1, "a"), (2, "b")]), folder, path)
    row = manifest.first()
    files, plain = shared.opened_folder(folder)
    with files.open_output_stream(f"{plain}/dictionary-{row['dictionary']}") as out:
        out.write(b"another")
    token_store._dictionary.cache_clear()
    with pytest.raises(ValueError, match="not the one"):
        token_store.read_document(folder, row["data"], row["index"], 1)


def test_token_store_of_nothing(spark):
    folder = token_store.store_folder(spark)
    manifest = token_store.write(brute.documents(spark, []), folder, tokenizer_path())
    assert manifest.count() == 0 and token_store.read(manifest, folder).count() == 0


# ---- toxicity


def labelled(spark, rows):
    docs = brute.documents(spark, [(i, t) for i, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if y is not None],
                                   "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    return docs, labels


def toxic_rows(rng, n):
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(WORDS) for _ in range(30)]
        if toxic:
            words += rng.sample(["grobzu", "grobab", "grobei", "vile"], 2)
        if rng.random() < (0.8 if toxic else 0.1):  # the group is mentioned more where it is toxic
            words.append("muslims")
        rng.shuffle(words)
        rows.append((" ".join(words) + ".", int(toxic)))
    return rows


def test_toxicity_generalises_and_spares_mentions(spark):
    rng = random.Random(12)
    docs, labels = labelled(spark, toxic_rows(rng, 900))
    fair = toxicity.fit(docs, labels, toxicity.crc_held_out())
    plain = toxicity.fit(docs, labels, toxicity.crc_held_out(), counterfactual=0.0)
    probes = ["muslims w1 w2", "christians w1 w2", "w1 w2", "grobneu w3 vile", ""]
    fair_s, plain_s = [fair.score(p) for p in probes], [plain.score(p) for p in probes]
    assert fair_s[3] > 0.9 and max(fair_s[:3] + fair_s[4:]) < 0.5
    assert abs(fair_s[0] - fair_s[1]) < 0.5 * abs(plain_s[0] - plain_s[1])
    again = toxicity.fit(docs.repartition(5), labels.repartition(3), toxicity.crc_held_out())
    assert again == fair
    got = toxicity.score(docs, fair).collect()
    assert len(got) == 900
    held = [(r["score"], r["doc_id"] % 5 == 0) for r in got]
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.98


def test_toxicity_of_odd_rows(spark):
    rows = [(None, 1), ("", 0), (None, None), ("bad " * 50_000, 1), ("fine", 0)]
    docs, labels = labelled(spark, rows)
    labels = labels.unionByName(labels).unionByName(labels.limit(1).withColumn("toxic", F.lit(None).cast("int"))) \
        .unionByName(labels.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    model = toxicity.fit(docs, labels, lambda c: F.lit(False))
    assert [0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect()] == [True] * 5
    none = toxicity.fit(docs, labels.limit(0), lambda c: F.lit(False))
    assert none.score("anything") == 0.5
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_swaps_keep_to_their_kind():
    got = set(toxicity.swaps_of("Women spoke. A deaf man.", toxicity.IDENTITY_TERMS))
    assert ("women", "men") in got and ("deaf", "blind") in got and ("women", "man") not in got
