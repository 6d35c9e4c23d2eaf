"""Whole rules: composition, library thresholds, order, previews, many at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import Rule
from factloom.functions import thresholds
from factloom.operators import browse, catalogue, report
from factloom.plans import rule_index, rules

from . import tables as t
from .base import query, scratch

ALL = {"type": "and", "children": []}


def cmp(key, op, value=None):
    return {"type": "cmp", "key": key, "op": op, "value": value}


def agg(key, op, kind, arg=None):
    return {"type": "agg_cmp", "key": key, "op": op, "agg": kind, "agg_arg": arg}


def both(*children):
    return {"type": "and", "children": list(children)}


def either(*children):
    return {"type": "or", "children": list(children)}


def negate(child):
    return {"type": "not", "child": child}


def rule(root, kind, rule_id=1, **options):
    return Rule(rule_id, {"root": root}, types=(kind,), **options)


def found(frame, r, columns=("item_id",), **options):
    return rules.evaluate(frame, r, t.REGISTRY, columns=columns, ordered=bool(r.limit),
                          now=t.ORDERS_NOW, **options)


# ── flagship and scope ────────────────────────────────────────────────────────

FLAGSHIP = both(
    cmp("part.size", "gte", 20),
    cmp("part.brand", "in", [f"Brand#{n}" for n in range(1, 16)]),
    negate(cmp("part.type", "eq", "ECONOMY")),
    agg("part.price", "gte", "percentile", 25),
)
RANKED = "(SELECT {v} AS v, row_number() OVER (ORDER BY {v}) - 1 AS r, count(*) OVER () AS n " \
         "FROM {t} WHERE {v} IS NOT NULL)"


def nearest(table, value, q):
    return (f"(SELECT v FROM {RANKED.format(v=value, t=table)} "
            f"WHERE r = floor((n - 1) * {q} + 0.5))")


BRANDS = ", ".join(f"'brand#{n}'" for n in range(1, 16))


@query("match", f"""
    SELECT p_partkey AS item_id, p_name AS title, p_retailprice AS price FROM part
    WHERE p_size >= 20 AND lower(p_brand) IN ({BRANDS}) AND p_type <> 'ECONOMY'
      AND p_retailprice >= {nearest('part', 'p_retailprice', 0.25)}
    ORDER BY p_retailprice DESC, p_partkey LIMIT 50""")
def match(spark, sf):
    top = rule(FLAGSHIP, "part", order_by="part.price", limit=50)
    return found(t.parts(spark, sf), top,
                 ["item_id", "title", F.col("part.price").alias("price")])


@query("match_count", f"""
    SELECT count(*) AS matched FROM part
    WHERE p_size >= 20 AND lower(p_brand) IN ({BRANDS}) AND p_type <> 'ECONOMY'
      AND p_retailprice >= {nearest('part', 'p_retailprice', 0.25)}""")
def match_count(spark, sf):
    return rules.count(t.parts(spark, sf), rule(FLAGSHIP, "part"), t.REGISTRY)


@query("scope_orders", """
    SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus IN ('P', 'F')
      AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def scope_orders(spark, sf):
    frame = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("library_key"),
        F.col("o_orderpriority").alias("item_type"),
        F.lit(None).cast("bigint").alias("deleted_at"))
    return catalogue.scope(frame, ["P", "F"], ["1-URGENT", "2-HIGH"]).select("item_id")


@query("scope_partitioned", """
    SELECT o_orderkey AS item_id, o_orderstatus AS library_key FROM orders
    WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority = '3-MEDIUM'""")
def scope_partitioned(spark, sf):
    """Written by library and type; the scoped scan prunes to the folders it needs."""
    path = scratch(spark, "catalogue")
    catalogue.write(t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("rating_key"),
        F.col("o_orderstatus").alias("library_key"),
        F.col("o_orderpriority").alias("item_type"),
        F.lit(None).cast("bigint").alias("deleted_at")), path)
    return catalogue.scope(catalogue.read(spark, path), ["O", "F"], ["3-MEDIUM"]).select(
        "item_id", "library_key")


# ── composition ───────────────────────────────────────────────────────────────


def docs_query(name, root, where, **options):
    @query(name, f"SELECT doc_id AS item_id FROM {t.DOCS_SQL} WHERE {where}")
    def run(spark, sf):
        return found(t.documents(spark, sf), rule(root, "document"), **options)


docs_query("bool_nested",
           both(either(cmp("label.toxic", "is_true"), cmp("label.quality", "eq", 0)),
                negate(both(cmp("doc.lang", "in", ["en", "de"]), cmp("doc.chars", "lt", 2000)))),
           "(toxic = 1 OR quality = 0) AND NOT (lang IN ('en', 'de') AND n_chars < 2000)")
docs_query("not_over_positive", negate(cmp("label.quality", "eq", 1)), "NOT (quality = 1)")
docs_query("not_over_guarded", negate(cmp("label.quality", "ne", 1)),
           "NOT (quality IS NOT NULL AND quality <> 1)")
docs_query("not_over_guarded_null", negate(cmp("label.quality", "ne", 1)), "quality = 1",
           unknown="null")
docs_query("empty_and_or", both(both(), negate(either()), cmp("doc.lang", "eq", "fr")),
           "true AND NOT false AND lang = 'fr'")
docs_query("const_node", either({"type": "const", "value": False},
                                both({"type": "const", "value": True},
                                     cmp("doc.source", "ends_with", "7"))),
           "false OR (true AND ends_with(source, '7'))")
docs_query("empty_operands",
           both(cmp("label.quality", "not_in", []), negate(cmp("doc.source", "in", [])),
                cmp("doc.chars", "gt", 1000)), "n_chars > 1000")


@query("not_over_list", f"""
    SELECT o_orderkey AS item_id FROM {t.ORDERS_SQL}
    WHERE NOT (CASE WHEN flags IS NOT NULL THEN list_contains(flags, 'R') END)""")
def not_over_list(spark, sf):
    return found(t.orders(spark, sf), rule(negate(cmp("order.flags", "contains", "R")), "order"))


# ── library thresholds ────────────────────────────────────────────────────────

LINE = ["item_id", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_SQL = "SELECT l_orderkey AS item_id, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE "


def lines_query(name, root, where):
    @query(name, LINE_SQL + where)
    def run(spark, sf):
        return found(t.lines(spark, sf), rule(root, "line"), LINE)


lines_query("agg_median", agg("line.price", "gt", "median"),
            f"l_extendedprice > {nearest('lineitem', 'l_extendedprice', 0.5)}")
lines_query("agg_pct90", agg("line.price", "gte", "percentile", 90),
            f"l_extendedprice >= {nearest('lineitem', 'l_extendedprice', 0.9)}")
lines_query("agg_pct_ties", agg("line.quantity", "lt", "percentile", 12.5),
            f"l_quantity < {nearest('lineitem', 'l_quantity', 0.125)}")
lines_query("agg_two_in_one",
            both(agg("line.price", "gt", "percentile", 75), agg("line.quantity", "lte", "median"),
                 agg("line.discount", "gte", "max")),
            f"l_extendedprice > {nearest('lineitem', 'l_extendedprice', 0.75)} "
            f"AND l_quantity <= {nearest('lineitem', 'l_quantity', 0.5)} "
            f"AND l_discount >= (SELECT max(l_discount) FROM lineitem)")


@query("agg_mean", "SELECT p_partkey AS item_id FROM part "
                   "WHERE p_size > (SELECT avg(p_size) FROM part)")
def agg_mean(spark, sf):
    return found(t.parts(spark, sf), rule(agg("part.size", "gt", "mean"), "part"))


@query("agg_min", f"SELECT doc_id AS item_id FROM {t.DOCS_SQL} WHERE quality IS NOT NULL "
                  f"AND quality <= (SELECT min(quality) FROM labels)")
def agg_min(spark, sf):
    return found(t.documents(spark, sf), rule(agg("label.quality", "lte", "min"), "document"))


@query("agg_max", "SELECT p_partkey AS item_id FROM part "
                  "WHERE p_size >= (SELECT max(p_size) FROM part)")
def agg_max(spark, sf):
    return found(t.parts(spark, sf), rule(agg("part.size", "gte", "max"), "part"))


@query("agg_within_scope", f"""
    SELECT p_partkey AS item_id FROM part WHERE p_brand IN ('Brand#3', 'Brand#4')
      AND p_retailprice > {nearest("(SELECT * FROM part WHERE p_brand IN ('Brand#3', 'Brand#4'))",
                                   'p_retailprice', 0.6)}""")
def agg_within_scope(spark, sf):
    return found(t.parts(spark, sf), rule(agg("part.price", "gt", "percentile", 60), "part",
                                          libraries=("Brand#3", "Brand#4")))


@query("agg_empty_scope", f"""
    SELECT doc_id AS item_id, false AS hit, quality IS NULL AS not_hit FROM {t.DOCS_SQL}""")
def agg_empty_scope(spark, sf):
    """No population, no threshold: nothing passes, and NOT passes what is unknown."""
    frame = t.documents(spark, sf)
    spec = t.REGISTRY.require("label.quality")
    ask = thresholds.Request("nowhere", spec, "median")
    bounds = thresholds.compute(frame, [ask], {"nowhere": F.col("library_key") == "nowhere"})
    tree = {"root": agg("label.quality", "gt", "median")}
    test = rules.condition(tree, t.REGISTRY, bounds, scope_key="nowhere")
    return frame.select("item_id", F.coalesce(test, F.lit(False)).alias("hit"),
                        F.coalesce(~test, F.lit(False)).alias("not_hit"))


QUANTILES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


@query("rank_thresholds", " UNION ALL ".join(
    f"SELECT '{c}' AS fact, CAST({q} AS DOUBLE) AS q, {nearest('lineitem', c, q)} AS threshold"
    for c in ("l_extendedprice", "l_quantity") for q in QUANTILES))
def rank_thresholds(spark, sf):
    frame = t.lines(spark, sf)
    asks = {
        thresholds.Request("", t.REGISTRY.require(key), "percentile", q * 100): (name, q)
        for key, name in (("line.price", "l_extendedprice"), ("line.quantity", "l_quantity"))
        for q in QUANTILES
    }
    got = thresholds.compute(frame, asks)
    return spark.createDataFrame(
        [(*asks[a], v) for a, v in got.items()], "fact string, q double, threshold double")


# ── order and limit ───────────────────────────────────────────────────────────


def ordered_query(name, fixture, kind, key, descending, limit, sql, root=ALL):
    @query(name, sql)
    def run(spark, sf):
        return found(fixture(spark, sf), rule(root, kind, order_by=key, descending=descending,
                                              limit=limit))


for direction in ("asc", "desc"):
    ordered_query(
        f"order_fact_nulls_last_{direction}", t.documents, "document", "label.quality",
        direction == "desc", 450,
        f"SELECT doc_id AS item_id FROM {t.DOCS_SQL} "
        f"ORDER BY quality {direction} NULLS LAST, doc_id LIMIT 450")
ordered_query("order_title", t.parts, "part", "title", False, 75,
              "SELECT p_partkey AS item_id FROM part ORDER BY lower(p_name), p_partkey LIMIT 75")
ordered_query("order_default", t.orders, "order", None, True, 60,
              "SELECT o_orderkey AS item_id FROM orders "
              "ORDER BY lower(o_orderpriority), o_orderkey LIMIT 60")
ordered_query("order_year", t.orders, "order", "year", True, 40,
              "SELECT o_orderkey AS item_id FROM orders "
              "ORDER BY year(o_orderdate) DESC, o_orderkey LIMIT 40")
ordered_query("order_added", t.orders, "order", "added_at", False, 40,
              "SELECT o_orderkey AS item_id FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40")
ordered_query("top_n", t.parts, "part", "size", True, 100,
              "SELECT p_partkey AS item_id FROM part WHERE p_type = 'PROMO' "
              "ORDER BY p_size DESC, p_partkey LIMIT 100", cmp("part.type", "eq", "PROMO"))


@query("order_random", "SELECT p_partkey AS item_id FROM part")
def order_random(spark, sf):
    """All parts in random order; the SQL checks that none is lost."""
    r = rule(ALL, "part", order_by="random")
    return rules.evaluate(t.parts(spark, sf), r, t.REGISTRY, columns=["item_id"], seed=42)


# ── previews and matches ──────────────────────────────────────────────────────

LABELLED = both(cmp("label.quality", "gte", 1), cmp("doc.chars", "gt", 300))


def label_provenance(spark, sf):
    return t.table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"), F.lit("labels").alias("provider"),
        F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"))


@query("preview_counts", f"""
    SELECT count(*) FILTER (WHERE quality >= 1 AND n_chars > 300) AS matched,
           count(*) AS in_scope, count(*) FILTER (WHERE toxic IS NULL OR toxic = 1) AS stale,
           least(100, count(*) FILTER (WHERE quality >= 1 AND n_chars > 300)) AS collection_size
    FROM {t.DOCS_SQL}""")
def preview_counts(spark, sf):
    r = rule(LABELLED, "document", limit=100)
    return rules.preview(t.documents(spark, sf), label_provenance(spark, sf), r, t.REGISTRY)[0]


@query("preview_sample", f"""
    SELECT doc_id AS item_id, n_chars AS file_size FROM {t.DOCS_SQL}
    WHERE quality >= 1 AND n_chars > 300 ORDER BY n_chars DESC, doc_id LIMIT 20""")
def preview_sample(spark, sf):
    r = rule(LABELLED, "document", order_by="doc.chars", limit=5)
    return rules.preview(t.documents(spark, sf), label_provenance(spark, sf), r, t.REGISTRY,
                         sample_size=20, columns=["item_id", "file_size"])[1]


@query("rule_matches", f"""
    SELECT doc_id AS item_id FROM {t.DOCS_SQL} WHERE quality >= 1 AND n_chars > 300
    ORDER BY n_chars, doc_id LIMIT 200""")
def rule_matches(spark, sf):
    r = rule(LABELLED, "document", order_by="size", descending=False)
    return rules.matches(t.documents(spark, sf), r, t.REGISTRY, limit=200, columns=["item_id"])


@query("stale_anti", "SELECT doc_id AS item_id FROM documents WHERE doc_id NOT IN "
                     "(SELECT doc_id FROM labels WHERE toxic <> 1)")
def stale_anti(spark, sf):
    r = rule(cmp("label.quality", "gte", 1), "document")
    return rules.without_facts(t.documents(spark, sf), label_provenance(spark, sf), r,
                               t.REGISTRY).select("item_id")


# ── many rules in one pass ────────────────────────────────────────────────────

MANY = [
    Rule(1, {"root": cmp("part.size", "gte", 40)}, types=("part",)),
    Rule(2, {"root": both(cmp("part.name", "contains", "red"),
                          negate(cmp("part.type", "in", ["PROMO", "SMALL"])))}, types=("part",)),
    Rule(3, {"root": agg("part.price", "gt", "percentile", 80)}, types=("part",)),
    Rule(4, {"root": agg("part.size", "lt", "mean")}, types=("part",),
         libraries=("Brand#1", "Brand#2")),
    Rule(5, {"root": cmp("part.brand", "starts_with", "brand#2")}, types=("part",),
         order_by="part.price", limit=30),
    Rule(6, {"root": ALL}, types=("part",), enabled=False),
    Rule(7, {"root": agg("part.price", "lte", "percentile", 80)}, types=("part",),
         order_by="title", descending=False, limit=25),
]
P80 = nearest("part", "p_retailprice", 0.8)
MANY_SQL = f"""
    SELECT 1 AS rule_id, p_partkey AS item_id FROM part WHERE p_size >= 40 UNION ALL
    SELECT 2, p_partkey FROM part WHERE contains(p_name, 'red') AND p_type NOT IN ('PROMO', 'SMALL')
    UNION ALL SELECT 3, p_partkey FROM part WHERE p_retailprice > {P80} UNION ALL
    SELECT 4, p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')
      AND p_size < (SELECT avg(p_size) FROM part WHERE p_brand IN ('Brand#1', 'Brand#2'))
    UNION ALL SELECT * FROM (SELECT 5, p_partkey FROM part WHERE starts_with(p_brand, 'Brand#2')
      ORDER BY p_retailprice DESC, p_partkey LIMIT 30) UNION ALL
    SELECT * FROM (SELECT 7, p_partkey FROM part WHERE p_retailprice <= {P80}
      ORDER BY lower(p_name), p_partkey LIMIT 25)"""


@query("many_rules", MANY_SQL)
def many_rules(spark, sf):
    return rules.evaluate_all(t.parts(spark, sf), MANY, t.REGISTRY)


TOPS = [
    Rule(n, {"root": root}, types=("part",), order_by=order, descending=falling, limit=limit)
    for n, (root, order, falling, limit) in enumerate([
        (cmp("part.size", "gte", 10), "part.price", True, 40),
        (cmp("part.type", "eq", "PROMO"), "size", False, 25),
        (agg("part.price", "lt", "percentile", 30), "part.size", True, 30),
        (cmp("part.name", "contains", "r"), "title", True, 20),
        (cmp("part.size", "lt", 30), "part.brand", True, 15),
        (ALL, None, True, 35),
        (cmp("part.size", "in", [1, 2, 3]), "part.type", False, 10),
    ])
]
_TOP_SQL = [
    ("p_size >= 10", "p_retailprice DESC", 40), ("p_type = 'PROMO'", "p_size", 25),
    (f"p_retailprice < {nearest('part', 'p_retailprice', 0.3)}", "p_size DESC", 30),
    ("contains(p_name, 'r')", "lower(p_name) DESC", 20),
    ("p_size < 30", "lower(p_brand) DESC", 15), ("true", "lower(p_name)", 35),
    ("p_size IN (1, 2, 3)", "lower(p_type)", 10),
]


@query("many_top_n", " UNION ALL ".join(
    f"SELECT * FROM (SELECT {n} AS rule_id, p_partkey AS item_id FROM part WHERE {where} "
    f"ORDER BY {order}, p_partkey LIMIT {limit})"
    for n, (where, order, limit) in enumerate(_TOP_SQL)))
def many_top_n(spark, sf):
    """Seven top-N rules in three passes: by number, by text, by text falling."""
    return rules.evaluate_all(t.parts(spark, sf), TOPS, t.REGISTRY)


# ── browsing ──────────────────────────────────────────────────────────────────


@query("browse_page", f"""
    SELECT doc_id AS item_id, n_chars AS file_size,
           3 + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS fact_count
    FROM {t.DOCS_SQL} WHERE contains(lower(text), 'the')
    ORDER BY n_chars DESC, doc_id LIMIT 40 OFFSET 20""")
def browse_page(spark, sf):
    return browse.items(t.documents(spark, sf), t.REGISTRY, q="THE", sort="size",
                        descending=True, limit=40, offset=20, columns=["item_id", "file_size"])


@query("browse_deep_page", f"""
    SELECT doc_id AS item_id, n_chars AS file_size,
           3 + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS fact_count
    FROM {t.DOCS_SQL} WHERE contains(lower(text), 'the')
    ORDER BY n_chars DESC, doc_id LIMIT 40 OFFSET 80""")
def browse_deep_page(spark, sf):
    """The third page by cursor: each page is sorted from where the one before it ended."""
    docs = t.documents(spark, sf)

    def page(after):
        return browse.items(docs, t.REGISTRY, q="THE", sort="size", descending=True, limit=40,
                            columns=["item_id", "file_size"], after=after, with_cursor=True)

    after = None
    for _ in range(2):
        seen = page(after).collect()  # a page of 40 rows
        after = seen[-1].cursor if seen else after
    return page(after).drop("cursor")


@query("browse_total", "SELECT count(*) AS total FROM documents "
                       "WHERE contains(lower(text), 'an')")
def browse_total(spark, sf):
    return browse.total(t.documents(spark, sf), q="AN")


@query("item_detail", """
    SELECT doc_id AS item_id, provider, coalesce(fp <> file_fp, false) AS stale FROM (
        SELECT doc_id, provider, fp, CASE WHEN lang <> 'es' THEN lang END AS file_fp
        FROM documents LEFT JOIN (
            SELECT doc_id, 'labels' AS provider, CASE WHEN quality = 1 THEN 'fr' END AS fp
            FROM labels) USING (doc_id))""")
def item_detail(spark, sf):
    """Every document with its provenance and whether that is out of date."""
    docs = t.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("file_fp"))
    prov = t.table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"), F.lit("labels").alias("provider"),
        F.when(F.col("quality") == 1, "fr").alias("input_fp"))
    return browse.with_stale(docs.join(prov, "item_id", "left")).select(
        "item_id", "provider", "stale")


@query("item_detail_one", """
    SELECT d.doc_id AS item_id, source, provider, coalesce(fp <> lang, false) AS stale
    FROM documents d LEFT JOIN (
        SELECT doc_id, 'labels' AS provider, CASE WHEN quality = 1 THEN 'fr' END AS fp FROM labels
        UNION ALL SELECT doc_id, 'chars', lang FROM documents) p USING (doc_id)
    WHERE d.doc_id = (SELECT max(doc_id) FROM labels)""")
def item_detail_one(spark, sf):
    """One item with the provenance of each of its providers."""
    docs = t.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), "source", F.col("lang").alias("file_fp"))
    prov = t.table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"), F.lit("labels").alias("provider"),
        F.when(F.col("quality") == 1, "fr").alias("input_fp"))
    prov = prov.unionByName(t.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.lit("chars").alias("provider"), F.col("lang").alias("input_fp")))
    last = t.table(spark, sf, "labels").agg(F.max("doc_id")).first()[0]
    return browse.detail(docs, prov, last).select("item_id", "source", "provider", "stale")


@query("recent_top_k", "SELECT event_id, user_id, event_type FROM events "
                       "ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_top_k(spark, sf):
    return report.recent(t.table(spark, sf, "events"), 50, at="ts", tie="event_id").select(
        "event_id", "user_id", "event_type")


@query("recent_of_rule", "SELECT event_id FROM events WHERE event_type = 'purchase' "
                         "ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_of_rule(spark, sf):
    log = t.table(spark, sf, "events").withColumnRenamed("event_type", "rule_id")
    return report.recent(log, 20, "purchase", "ts", "event_id").select("event_id")


# ── ten thousand rules ────────────────────────────────────────────────────────
# Rule i asks for a brand, a size and a price band that depend on i, in one of four forms; every
# seventh asks also for a price over a share of the library, every fifth keeps its dearest three.


def numbered_rule(i: int) -> rules.Rule:
    brand, size, low = f"Brand#{1 + i % 25}", 1 + i % 50, 900 + i % 1000
    band = cmp("part.price", "between", [low, low + 40])
    root = [
        both(cmp("part.brand", "eq", brand), cmp("part.size", "eq", size)),
        both(either(cmp("part.brand", "eq", brand), cmp("part.name", "starts_with", "hot")),
             cmp("part.size", "in", [size, size + 1]), band),
        both(negate(either(cmp("part.price", "lt", low), cmp("part.price", "gt", low + 40),
                           cmp("part.brand", "ne", brand))), cmp("part.type", "ne", "PROMO")),
        both(cmp("part.size", "eq", size), negate(cmp("part.name", "contains", "e")), band),
    ][i % 4]
    if i % 7 == 0:
        root = both(root, agg("part.price", "gte", "percentile", 50))
    return rule(root, "part", i, order_by="part.price", limit=3 if i % 5 == 0 else None)


NUMBERED = 10_000


@query("many_rules_indexed", f"""
    WITH r AS (
        SELECT i, 'brand#' || (1 + i % 25) AS brand, 1 + i % 50 AS size, 900 + i % 1000 AS low FROM range({NUMBERED}) t(i)
    ), met AS (
        SELECT i AS rule_id, p_partkey AS item_id, p_retailprice AS price
        FROM part JOIN r ON CASE i % 4
            WHEN 0 THEN lower(p_brand) = brand AND p_size = size
            WHEN 1 THEN (lower(p_brand) = brand OR starts_with(lower(p_name), 'hot')) AND p_size IN (size, size + 1)
                        AND p_retailprice BETWEEN low AND low + 40
            WHEN 2 THEN p_retailprice BETWEEN low AND low + 40 AND lower(p_brand) = brand AND p_type <> 'PROMO'
            ELSE p_size = size AND NOT contains(lower(p_name), 'e') AND p_retailprice BETWEEN low AND low + 40 END
        WHERE i % 7 <> 0 OR p_retailprice >= {nearest('part', 'p_retailprice', 0.5)}
    )
    SELECT rule_id, item_id FROM met
    QUALIFY rule_id % 5 <> 0 OR row_number() OVER (PARTITION BY rule_id ORDER BY price DESC, item_id) <= 3""")
def many_rules_indexed(spark, sf):
    """Ten thousand rules in a plan whose size does not depend on their number."""
    return rule_index.evaluate_many(t.parts(spark, sf), map(numbered_rule, range(NUMBERED)), t.REGISTRY)
