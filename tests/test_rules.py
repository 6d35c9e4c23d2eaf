"""Predicates, composition, thresholds, ordering, on a few items with known answers."""

from collections import namedtuple

import pytest
from conftest import agg, cmp, group, negate
from pyspark.sql import functions as F

from factloom import Rule, RuleError
from factloom.functions.predicates import OPERATORS, emit
from factloom.functions.spec import FactSpec, FactType, date, enum, flag, number, text, words
from factloom.plans import rules

SCHEMA = (
    "item_id string, library_key string, rating_key string, item_type string, title string, "
    "sort_title string, year int, added_at bigint, file_size bigint, deleted_at bigint, "
    "video struct<dar:double,hdr_format:string,codec:string>, "
    "file struct<bitrate_kbps:double,duration_s:double>, "
    "derived struct<is_scope:boolean>, audio struct<languages:array<string>>"
)
Film = namedtuple("Film", "title dar rate length hdr langs")
FILMS = [
    Film("Amber", 2.20, 5200, 5400, "hdr10", ["por"]),
    Film("Birch", 1.66, 900, 6600, "sdr", ["por", "swe"]),
    Film("Cedar", 2.55, 21000, 7300, "hlg", ["swe", "fin"]),
    Film("Elm", 1.33, 15500, 4100, "sdr", []),
    Film("Fir", 2.35, 8800, 9900, "dv_p5", ["fin"]),
    Film("Hazel", None, None, None, None, None),
    Film("Ivy", 1.85, 33000, 3600, "hdr10", ["por", "fin", "swe"]),
]
KNOWN = [f for f in FILMS if f.dar is not None]
MIDDLE_RATE, MEAN_RATE, MIDDLE_LENGTH = 15500, sum(f.rate for f in KNOWN) / 6, 6600


@pytest.fixture(scope="module")
def films(spark):
    rows = [
        (str(i), "1", str(i), "movie", title, title, 2020, None, None, None,
         (dar, hdr, None) if dar else None,
         (float(rate), float(length)) if rate else None,
         (dar >= 2.3,) if dar else None, (langs,) if langs is not None else None)
        for i, (title, dar, rate, length, hdr, langs) in enumerate(FILMS)
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def titles(films, registry):
    def run(root, unknown="parity", **options):
        rule = Rule(1, {"root": root}, libraries=("1",), order_by="title", descending=False,
                    **options)
        return [r.title for r in
                rules.evaluate(films, rule, registry, unknown=unknown).collect()]
    return run


# (tree, what it means for a film whose facts are known, whether the unknown film matches)
CASES = [
    (cmp("video.dar", "lte", 1.7), lambda f: f.dar <= 1.7, False),
    (cmp("video.dar", "between", [2.4, 1.8]), lambda f: 1.8 <= f.dar <= 2.4, False),
    (cmp("video.dar", "is_not_null"), lambda f: True, False),
    (cmp("file.duration_s", "is_null"), lambda f: False, True),
    (cmp("video.hdr_format", "eq", "HDR10"), lambda f: f.hdr == "hdr10", False),
    (cmp("video.hdr_format", "ne", "hdr10"), lambda f: f.hdr != "hdr10", False),
    (cmp("video.hdr_format", "in", ["hlg", "dv_p5", "hlg"]), lambda f: f.hdr in ("hlg", "dv_p5"), False),
    (cmp("video.hdr_format", "not_in", ["hlg"]), lambda f: f.hdr != "hlg", False),
    (cmp("video.hdr_format", "in", []), lambda f: False, False),
    (cmp("video.hdr_format", "not_in", []), lambda f: True, True),
    (cmp("derived.is_scope", "is_true"), lambda f: f.dar >= 2.3, False),
    (cmp("derived.is_scope", "is_false"), lambda f: f.dar < 2.3, False),
    (cmp("audio.languages", "contains", "Swe"), lambda f: "swe" in f.langs, False),
    (cmp("audio.languages", "not_contains", "swe"), lambda f: "swe" not in f.langs, False),
    (cmp("audio.languages", "contains_any", ["por", "xyz"]), lambda f: "por" in f.langs, False),
    (cmp("audio.languages", "contains_all", ["swe", "por", "swe"]), lambda f: {"swe", "por"} <= set(f.langs), False),
    (cmp("audio.languages", "contains_any", []), lambda f: False, False),
    (cmp("audio.languages", "contains_all", []), lambda f: True, True),
    (cmp("audio.languages", "is_empty"), lambda f: not f.langs, False),
    (cmp("audio.languages", "length_lte", 1), lambda f: len(f.langs) <= 1, False),
    (group("and"), lambda f: True, True),
    (group("or"), lambda f: False, False),
    ({"type": "const", "value": True}, lambda f: True, True),
    ({"type": "const", "value": False}, lambda f: False, False),
    (group("or", cmp("video.dar", "lt", 1.5), cmp("file.bitrate_kbps", "gt", 30000)),
     lambda f: f.dar < 1.5 or f.rate > 30000, False),
    (group("and", cmp("video.dar", "gt", 1.5), cmp("file.bitrate_kbps", "lt", 9000), cmp("derived.is_scope", "is_false")),
     lambda f: 1.5 < f.dar < 2.3 and f.rate < 9000, False),
    (negate(cmp("video.dar", "gt", 2)), lambda f: f.dar <= 2, False),
    (negate(cmp("audio.languages", "contains", "fin")), lambda f: "fin" not in f.langs, False),
    (agg("file.bitrate_kbps", "lte", "median"), lambda f: f.rate <= MIDDLE_RATE, False),
    (agg("file.bitrate_kbps", "gt", "percentile", 50), lambda f: f.rate > MIDDLE_RATE, False),
    (agg("file.bitrate_kbps", "gte", "percentile", 90), lambda f: f.rate >= 33000, False),
    (agg("file.bitrate_kbps", "gt", "mean"), lambda f: f.rate > MEAN_RATE, False),
    (agg("file.bitrate_kbps", "gt", "min"), lambda f: f.rate > 900, False),
    (agg("file.bitrate_kbps", "lt", "max"), lambda f: f.rate < 33000, False),
    # the threshold is the library's, whatever else the rule asks
    (group("and", cmp("video.dar", "lt", 2), agg("file.bitrate_kbps", "gte", "median")),
     lambda f: f.dar < 2 and f.rate >= MIDDLE_RATE, False),
    (group("or", agg("file.bitrate_kbps", "lt", "median"), agg("file.duration_s", "gt", "median")),
     lambda f: f.rate < MIDDLE_RATE or f.length > MIDDLE_LENGTH, False),
    # a guarded test is FALSE for an unknown fact, so NOT over it lets unknown items in
    (negate(cmp("video.hdr_format", "ne", "sdr")), lambda f: f.hdr == "sdr", True),
    (negate(agg("file.bitrate_kbps", "lt", "median")), lambda f: f.rate >= MIDDLE_RATE, True),
]


def meant(test, unknown):
    return [f.title for f in FILMS if (unknown if f.dar is None else test(f))]


@pytest.mark.parametrize("root,test,unknown", CASES)
def test_matches(titles, root, test, unknown):
    assert titles(root) == meant(test, unknown)


def test_unknown_null_keeps_unknown_items_out_of_not(titles):
    assert titles(negate(cmp("video.hdr_format", "ne", "sdr")), unknown="null") == ["Birch", "Elm"]


def test_threshold_of_an_empty_scope_matches_nothing(films, registry):
    rule = Rule(1, {"root": agg("file.bitrate_kbps", "gt", "median")}, libraries=("none",))
    assert rules.evaluate(films, rule, registry).count() == 0
    aside = Rule(1, {"root": agg("file.bitrate_kbps", "gt", "mean")}, types=("show",))
    assert rules.evaluate(films, aside, registry).count() == 0


def test_top_n_puts_unknown_last_both_ways(films, registry):
    everything = {"root": group("and")}
    for descending, first in ((True, ["Ivy", "Cedar", "Elm"]),
                              (False, ["Birch", "Amber", "Fir"])):
        rule = Rule(1, everything, order_by="file.bitrate_kbps", descending=descending)
        ordered = [r.title for r in rules.evaluate(films, rule, registry).collect()]
        assert ordered[:3] == first and ordered[-1] == "Hazel"
        assert rules.evaluate(films, rule, registry, limit=3).count() == 3


def test_default_order_is_title_and_random_is_complete(films, registry):
    rule = Rule(1, {"root": group("and")})
    assert [r.title for r in rules.evaluate(films, rule, registry).collect()] == sorted(
        f[0] for f in FILMS)
    shuffled = Rule(1, {"root": group("and")}, order_by="random")
    assert rules.evaluate(films, shuffled, registry, seed=5).count() == 7


@pytest.mark.parametrize("root,where", [
    (cmp("audio.volume", "eq", 3), "root"),
    (cmp("file.bitrate_kbps", "starts_with", "9"), "root"),
    (cmp("file.bitrate_kbps OR 1=1", "eq", 1), "root"),
    (cmp("file.bitrate_kbps", "gt", "fast"), "root"),
    (cmp("file.bitrate_kbps", "in", [1, "fast"]), "root"),
    (cmp("file.bitrate_kbps", "between", [1, 2, 3]), "root"),
    (cmp("video.hdr_format", "in", ["sdr", "cinerama"]), "root"),
    (cmp("plex.added_at", "before", "yesterday"), "root"),
    (agg("audio.codec", "gt", "mean"), "root"),
    (agg("file.bitrate_kbps", "ne", "mean"), "root"),
    (agg("file.bitrate_kbps", "lt", "sum"), "root"),
    (agg("file.bitrate_kbps", "lt", "percentile", -1), "root"),
    (agg("file.bitrate_kbps", "lt", "percentile", "high"), "root"),
    (group("or", cmp("video.dar", "gt", 1), group("and", negate(cmp("audio.volume", "eq", 1)))),
     "root.or[1].and[0].not"),
    ({"type": "nand", "children": []}, "root"),
    (negate(None), "root"),
    ({"type": "and", "children": "all"}, "root"),
    (7, "root"),
])
def test_rejected(registry, root, where):
    with pytest.raises(RuleError, match="^" + where.replace("[", r"\[").replace("]", r"\]")):
        rules.check({"root": root}, registry)


def test_size_limits(registry):
    deep = cmp("video.dar", "gte", 2.3)
    for _ in range(8):
        deep = negate(deep)
    rules.check({"root": deep}, registry)
    with pytest.raises(RuleError):
        rules.check({"root": negate(deep)}, registry)
    leaf = cmp("video.dar", "gte", 1)
    rules.check({"root": group("or", *[leaf] * 199)}, registry)
    with pytest.raises(RuleError):
        rules.check({"root": group("or", *[leaf] * 200)}, registry)
    with pytest.raises(RuleError):
        rules.check({}, registry)


def test_sort_keys(registry):
    assert rules.check_order("year", registry) == "year"
    assert rules.check_order(None, registry) is None
    for bad in ("audio.languages", "video.nope"):
        with pytest.raises(RuleError):
            rules.check_order(bad, registry)


def test_truth_table(spark):
    """Every operator on true, false, unknown, empty and null-element inputs."""
    frame = spark.createDataFrame(
        [(1, (5.0, "Ab%c", "X", True, 1000, ["a", "B"])),
         (2, (None, None, None, None, None, None)),
         (3, (0.0, "", "y", False, 0, [])),
         (4, (0.0, "", "y", False, 0, [None, "a"]))],
        "id int, t struct<n:double,s:string,e:string,b:boolean,d:bigint,l:array<string>>")
    specs = {"n": number("t.n"), "s": text("t.s"), "e": enum("t.e", "X", "Y"),
             "b": flag("t.b"), "d": date("t.d"), "l": words("t.l")}
    expected = {
        ("n", "eq", 5): (True, None, False, False), ("n", "ne", 5): (False, False, True, True),
        ("n", "gt", 1): (True, None, False, False), ("n", "gte", 5): (True, None, False, False),
        ("n", "lt", 1): (False, None, True, True), ("n", "lte", 0): (False, None, True, True),
        ("n", "between", (9, 1)): (True, None, False, False),
        ("n", "in", (5, 6)): (True, None, False, False),
        ("n", "not_in", (5, 6)): (False, False, True, True),
        ("n", "is_null", None): (False, True, False, False),
        ("n", "is_not_null", None): (True, False, True, True),
        ("d", "before", "1970-01-01T00:00:10Z"): (False, None, True, True),
        ("d", "after", 10): (True, None, False, False),
        ("d", "between", ("0", 5)): (False, None, True, True),
        ("d", "in_last_days", 1): (True, False, False, False),
        ("d", "not_in_last_days", 1): (False, False, True, True),
        ("d", "is_null", None): (False, True, False, False),
        ("d", "is_not_null", None): (True, False, True, True),
        ("s", "eq", "aB%C"): (True, None, False, False),
        ("s", "ne", "ab%c"): (False, False, True, True),
        ("s", "contains", "%"): (True, None, False, False),
        ("s", "not_contains", "B%"): (False, False, True, True),
        ("s", "starts_with", "AB"): (True, None, False, False),
        ("s", "ends_with", "_"): (False, None, False, False),
        ("s", "in", ("AB%C",)): (True, None, False, False),
        ("s", "not_in", ("AB%C",)): (False, False, True, True),
        ("s", "is_null", None): (False, True, False, False),
        ("s", "is_not_null", None): (True, False, True, True),
        ("e", "eq", "x"): (True, None, False, False), ("e", "ne", "x"): (False, False, True, True),
        ("e", "in", ("x",)): (True, None, False, False),
        ("e", "not_in", ("x",)): (False, False, True, True),
        ("e", "is_null", None): (False, True, False, False),
        ("e", "is_not_null", None): (True, False, True, True),
        ("b", "is_true", None): (True, None, False, False),
        ("b", "is_false", None): (False, False, True, True),
        ("b", "is_null", None): (False, True, False, False),
        ("b", "is_not_null", None): (True, False, True, True),
        ("l", "contains", "b"): (True, None, False, False),
        ("l", "not_contains", "b"): (False, None, True, True),
        ("l", "contains_any", ("b", "z")): (True, None, False, False),
        ("l", "contains_all", ("A", "b", "a")): (True, None, False, False),
        ("l", "length_gte", 2.7): (True, None, False, True),
        ("l", "length_lte", 1): (False, None, True, False),
        ("l", "is_empty", None): (False, None, True, False),
        ("l", "is_not_empty", None): (True, None, False, True),
    }
    tests = {
        k: emit(specs[k[0]], k[1], list(k[2]) if isinstance(k[2], tuple) else k[2],
                now=86400 + 500)
        for k in expected
    }
    assert len(expected) == sum(len(o) for o in OPERATORS.values()) == 46
    rows = frame.orderBy("id").select(*[c.alias(str(i)) for i, c in enumerate(tests.values())])
    got = rows.collect()
    for i, key in enumerate(expected):
        assert tuple(r[i] for r in got) == expected[key], key


def test_every_operand_of_a_long_list_counts(spark):
    frame = spark.range(450).select(F.struct(
        F.col("id").cast("double").alias("n"), F.array(F.col("id").cast("string")).alias("l")).alias("t"))
    tags = FactSpec(key="t.l", type=FactType.LIST, element=FactType.STRING)
    numbers = list(range(300))
    assert frame.filter(emit(number("t.n"), "in", numbers)).count() == 300
    assert frame.filter(emit(number("t.n"), "not_in", numbers)).count() == 150
    assert frame.filter(emit(tags, "contains_any", [str(n) for n in numbers])).count() == 300
    assert frame.filter(emit(tags, "contains_all", ["7"] * 300)).count() == 1
    assert frame.filter(emit(tags, "contains_all", [str(n) for n in numbers])).count() == 0
    with pytest.raises(RuleError):
        emit(number("t.n"), "in", [*numbers, "not a number"])


def test_rankings_of_a_shared_pass_are_those_of_one_rule(spark, registry):
    nan = float("nan")
    sizes = [1.0, 2.0, nan, None, float(2 ** 53), float(2 ** 53 + 2)]
    frame = spark.createDataFrame(
        [(str(i), "1", "movie", f"t{i}", i, (2 ** 53 + i), (v,)) for i, v in enumerate(sizes)],
        "item_id string, library_key string, item_type string, sort_title string, year int, "
        "file_size bigint, file struct<bitrate_kbps: double>").withColumn("deleted_at", F.lit(None).cast("bigint"))
    made = [Rule(f"{key}-{falling}-{n}", {"root": {"type": "and", "children": []}}, libraries=("1",),
                 order_by=key, descending=falling, limit=n)
            for key in ("file.bitrate_kbps", "size") for falling in (True, False) for n in (1, 3, 5000)]
    together = {}
    for row in rules.evaluate_all(frame, made, registry).collect():
        together.setdefault(row.rule_id, set()).add(row.item_id)
    for rule in made:
        alone = rules.evaluate(frame, rule, registry, columns=("item_id",)).collect()
        assert together[rule.rule_id] == {r.item_id for r in alone}, rule.rule_id


def test_spec_checks():
    for bad in (dict(key="Bad", type=FactType.NUMBER), dict(key="a", type=FactType.NUMBER),
                dict(key="a.b", type=FactType.ENUM), dict(key="a.b", type=FactType.LIST),
                dict(key="a.b", type=FactType.STRING, aggregatable=True)):
        with pytest.raises(ValueError):
            FactSpec(**bad)


def test_many_rules_agree_with_one_by_one(films, registry):
    made = [
        Rule(i, {"root": root}, libraries=("1",), order_by="file.bitrate_kbps",
             limit=2 if i % 5 == 4 else None)
        for i, (root, *_) in enumerate(CASES)
    ] + [Rule(99, {"root": group("and")}, enabled=False)]
    together = {}
    for row in rules.evaluate_all(films, made, registry).collect():
        together.setdefault(row.rule_id, set()).add(row.item_id)
    for rule in made[:-1]:
        alone = {r.item_id for r in rules.evaluate(films, rule, registry).collect()}
        assert together.get(rule.rule_id, set()) == alone, rule.rule_id
    assert 99 not in together


def test_preview_counts_and_sample(spark, films, registry):
    prov = spark.createDataFrame(
        [(i, "ffprobe", "ok") for i in "0126"] + [("3", "ffprobe", "skipped"), ("5", "tmdb", "ok")],
        "item_id string, provider string, status string")
    rule = Rule(1, {"root": cmp("video.dar", "gt", 2.1)}, limit=2, order_by="video.dar")
    counts, sample = rules.preview(films, prov, rule, registry, sample_size=5)
    assert counts.first().asDict() == {
        "matched": 3, "in_scope": 7, "stale": 3, "collection_size": 2}
    assert [r.title for r in sample.collect()] == ["Cedar", "Fir", "Amber"]
    assert {r.item_id for r in
            rules.without_facts(films, prov, rule, registry).collect()} == {"3", "4", "5"}
    assert rules.keys_of(rule.tree["root"]) == {"video.dar"}
    assert rules.count(films, rule, registry).first().matched == 3
    assert rules.matches(films, rule, registry).count() == 2


def test_preview_sample_is_whole_without_a_size(spark, films, registry):
    prov = spark.createDataFrame([], "item_id string, provider string, status string")
    many = films.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("_copy")
    rule = Rule(1, {"root": cmp("video.dar", "gt", 2.1)}, limit=2, order_by="video.dar")
    counts, sample = rules.preview(many, prov, rule, registry)
    assert sample.count() == counts.first()["matched"] == 90


def test_rule_from_saved_row(registry):
    rule = Rule.from_row({
        "id": 7, "rule_json": '{"root": {"type": "const", "value": true}}',
        "library_keys": '["1"]', "item_types": '["show"]', "order_by_key": None,
        "order_dir": "asc", "limit_n": 3, "name": "x", "enabled": 1})
    assert rule.libraries == ("1",) and rule.types == ("show",) and not rule.descending
    assert rule.limit == 3 and rules.check(rule.tree, registry)["root"]["value"] is True

