"""Snapshots, payload tables, files, paths, merges, reconcile, staleness."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.registry import Registry
from factloom.functions.scalars import seconds
from factloom.functions.spec import flag, measure, text, words
from factloom.operators import facts, paths, reconcile
from factloom.operators.providers import Provider
from factloom.plans import staleness
from factloom.sources import files, payloads, snapshot

from . import tables as t
from .base import ORACLES, query, scratch

# ── snapshots and payload tables ──────────────────────────────────────────────


def raw_snapshot(spark, sf):
    """Parts as raw library records with guid lists and two media of up to two parts."""
    def part(tag, size):
        return F.struct(F.concat(F.lit(tag), F.col("p_partkey")).alias("id"),
                        F.concat(F.lit("/"), F.col("p_name")).alias("file"),
                        size.cast("bigint").alias("size"))

    number, nothing = F.col("p_size"), F.lit(None)
    return t.table(spark, sf, "part").select(
        F.col("p_brand").alias("library_key"),
        F.when(number < 10, "episode").when(number < 20, "show").otherwise("movie")
        .alias("item_type"),
        F.col("p_partkey").cast("string").alias("rating_key"), F.col("p_type").alias("guid"),
        F.array(F.concat(F.lit("tmdb://"), F.col("p_partkey")),
                F.concat(F.lit("imdb://tt"), number), F.concat(F.lit("tvdb://"), F.col("p_type")))
        .alias("guids"),
        F.when(number != 7, F.col("p_name")).alias("title"),
        F.when(number > 30, F.upper("p_name")).alias("title_sort"),
        number.alias("year"), nothing.cast("bigint").alias("added_at"),
        nothing.cast("bigint").alias("updated_at"), (number * 60000).cast("bigint")
        .alias("duration"),
        F.when(number != 3, F.array(
            F.struct(F.array(part("a", number), part("b", 40 - number)).alias("parts")),
            F.struct(F.array(part("c", F.lit(20))).alias("parts")))).alias("media"),
        F.col("p_brand").alias("grandparent_key"), number.alias("parent_index"),
        (number + 1).alias("index"), number.alias("child_count"),
        (number * 2).alias("leaf_count"), (number * 3).alias("viewed_leaf_count"))


@query("snapshot_rows", """
    SELECT CAST(p_partkey AS VARCHAR) AS rating_key, p_partkey AS tmdb_id,
           'tt' || p_size AS imdb_id, CAST(NULL AS BIGINT) AS tvdb_id,
           CASE WHEN p_size = 7 THEN '(untitled)' ELSE p_name END AS title,
           CASE WHEN p_size > 30 THEN upper(p_name) WHEN p_size <> 7 THEN p_name END AS sort_title,
           CASE WHEN p_size < 10 THEN p_brand END AS parent_key,
           CASE WHEN p_size < 10 THEN p_size END AS season_number,
           CASE WHEN p_size >= 10 AND p_size < 20 THEN p_size * 2 END AS leaf_count
    FROM part""")
def snapshot_rows(spark, sf):
    return snapshot.normalize_snapshot(raw_snapshot(spark, sf)).select(
        "rating_key", "tmdb_id", "imdb_id", "tvdb_id", "title", "sort_title", "parent_key",
        "season_number", "leaf_count")


@query("largest_part", """
    SELECT CAST(p_partkey AS VARCHAR) AS rating_key,
           CASE WHEN p_size = 3 THEN NULL
                WHEN p_size >= 40 - p_size AND p_size >= 20 THEN 'a' || p_partkey
                WHEN 40 - p_size >= 20 THEN 'b' || p_partkey ELSE 'c' || p_partkey END AS part_id,
           CASE WHEN p_size <> 3 THEN CAST(greatest(p_size, 40 - p_size, 20) AS BIGINT) END
               AS source_size
    FROM part""")
def largest_part(spark, sf):
    return snapshot.normalize_snapshot(raw_snapshot(spark, sf)).select(
        "rating_key", "part_id", "source_size")


CACHE_SQL = """(
    SELECT event_type AS provider, user_id AS cache_key, props AS payload,
           CAST(floor(epoch(ts)) AS BIGINT) AS fetched_at, event_id,
           CAST(floor(value * 20000) AS BIGINT) AS ttl_s FROM events)"""


@query("fresh_payloads", f"""
    SELECT provider, cache_key, payload, fetched_at FROM (
        SELECT *, row_number() OVER (PARTITION BY provider, cache_key ORDER BY event_id DESC) AS r
        FROM {CACHE_SQL}) WHERE r = 1 AND {t.EVENTS_NOW} - fetched_at <= ttl_s""")
def fresh_payloads(spark, sf):
    events = t.table(spark, sf, "events")
    cache = events.select(
        F.col("event_type").alias("provider"), F.col("user_id").alias("cache_key"),
        F.col("props").alias("payload"), seconds(events, "ts").alias("fetched_at"),
        F.floor(F.col("value") * 20000).alias("ttl_s"))
    return payloads.fresh_payloads(cache, t.EVENTS_NOW).select(
        "provider", "cache_key", "payload", "fetched_at")


@query("last_wins", """
    SELECT o_custkey AS id, o_orderkey AS seq, o_totalprice AS price FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r
        FROM orders WHERE o_custkey <> 0) WHERE r = 1""")
def last_wins(spark, sf):
    rows = t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("price"))
    return payloads.keyed(rows, "id", "seq")


@query("semi_then_left", """
    SELECT c_custkey AS id, c_name AS name FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def semi_then_left(spark, sf):
    details = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    owners = t.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return payloads.wanted(details, "id", owners, "o_custkey")


@query("json_fact", """
    SELECT event_id AS item_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fact(spark, sf):
    return payloads.parse(t.table(spark, sf, "events"), "k BIGINT", "props").select(
        F.col("event_id").alias("item_id"), "doc.k")


# ── files and paths ───────────────────────────────────────────────────────────


@query("fingerprint", """
    SELECT doc_id, sha1(source || '/' || text || '|' || n_chars || '|' || doc_id) AS file_fp
    FROM documents""")
def fingerprint(spark, sf):
    rows = t.table(spark, sf, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), "text").alias("path"),
        F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    return files.with_fingerprint(rows).select("doc_id", "file_fp")


@query("file_manifest", """
    SELECT coalesce(source, '') AS folder, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size, false AS empty
    FROM documents GROUP BY 1 UNION ALL SELECT '_SUCCESS', 0, true""")
def file_manifest(spark, sf):
    """The documents as text files, a folder a source, found by walking; the mark of success is empty."""
    root = scratch(spark, "texts")
    t.table(spark, sf, "documents").select(
        F.coalesce("source", F.lit("")).alias("folder"), F.coalesce("text", F.lit("")).alias("value")).write.partitionBy(
        "folder").text(root)
    found = files.manifest(spark, root, mounted=True)
    folder = F.regexp_extract("path", "/(?:folder=([^/]*)/[^/]*|(_[^/]*))$", 1)
    mark = F.regexp_extract("path", "/(?:folder=([^/]*)/[^/]*|(_[^/]*))$", 2)
    return found.groupBy(F.when(mark != "", mark).otherwise(folder).alias("folder")).agg(
        F.sum("size").alias("size"), (F.max("size") == 0).alias("empty"))


MAPPINGS = [("https://www.", "/mnt/www"), ("http://", "/mnt/plain"), ("http://blog.", "/mnt/blog"),
            ("https://m.ththth.example.net/en", "/mnt/m/en/")]
# A prefix has to end where a component ends, so "http://blog." covers nothing.
TRANSLATED_SQL = """(
    SELECT page_id, url, CASE
        WHEN url = 'https://m.ththth.example.net/en' THEN '/mnt/m/en/'
        WHEN starts_with(url, 'https://m.ththth.example.net/en/')
            THEN '/mnt/m/en/' || url[length('https://m.ththth.example.net/en/') + 1:]
        WHEN starts_with(url, 'http://') THEN '/mnt/plain/' || url[8:] END AS raw
    FROM pages)"""
LOCAL_SQL = f"""(
    SELECT page_id, url, CASE WHEN ends_with(raw, '/') THEN raw[:-2] ELSE raw END AS local_path
    FROM {TRANSLATED_SQL})"""


def page_items(spark, sf):
    return t.table(spark, sf, "pages").select(
        F.col("page_id").alias("item_id"), F.col("url").alias("source_path"),
        F.lit(None).cast("bigint").alias("deleted_at"))


@query("prefix_join", f"SELECT page_id AS item_id, local_path FROM {LOCAL_SQL}")
def prefix_join(spark, sf):
    return paths.translate(page_items(spark, sf), MAPPINGS).select("item_id", "local_path")


@query("prefix_join_many", f"SELECT page_id AS item_id, local_path FROM {LOCAL_SQL}")
def prefix_join_many(spark, sf):
    """The same, with the mappings as a table that is joined on the ancestors of each path."""
    hosts = t.table(spark, sf, "pages").select(
        F.concat(F.lit("ftp://"), F.parse_url("url", F.lit("HOST"))).alias("source"),
        F.lit("/mnt/ftp").alias("local"))
    mappings = spark.createDataFrame(MAPPINGS, "source string, local string").unionByName(hosts)
    return paths.translate(page_items(spark, sf), mappings).select("item_id", "local_path")


def page_manifest(spark, sf):
    """Pages without a query string are there, under their translated path."""
    there = t.table(spark, sf, "pages").filter(~F.col("url").contains("?")).select(
        F.col("page_id").alias("item_id"), F.col("url").alias("source_path"),
        F.length("html").cast("bigint").alias("size"))
    local = paths.translate(there, MAPPINGS, out="path")
    return local.filter("path IS NOT NULL").groupBy("path").agg(
        F.max("size").alias("size"), F.max("item_id").alias("mtime"))


STATUS_SQL = f"""(
    WITH local AS (SELECT * FROM {LOCAL_SQL}),
    there AS (SELECT local_path, max(length(html)) AS size FROM local JOIN pages USING (page_id)
              WHERE NOT contains(pages.url, '?') AND local_path IS NOT NULL GROUP BY 1)
    SELECT page_id, url, local_path, size, CASE WHEN local_path IS NULL THEN 'unmapped'
        WHEN size IS NULL THEN 'missing' ELSE 'mapped' END AS status
    FROM local LEFT JOIN there USING (local_path))"""


def resolved_pages(spark, sf):
    return paths.resolve(page_items(spark, sf), MAPPINGS, page_manifest(spark, sf))


@query("path_status", f"""
    SELECT page_id AS item_id, local_path, status AS path_status, size AS file_size
    FROM {STATUS_SQL}""")
def path_status(spark, sf):
    return resolved_pages(spark, sf).select("item_id", "local_path", "path_status", "file_size")


@query("path_health", f"""
    SELECT path_status, coalesce(n, 0) AS n FROM
        (VALUES ('mapped'), ('unmapped'), ('missing'), ('unknown')) s(path_status)
    LEFT JOIN (SELECT status, count(*) AS n FROM {STATUS_SQL} GROUP BY 1) ON status = path_status""")
def path_health(spark, sf):
    return paths.health(resolved_pages(spark, sf))


@query("path_missing", f"""
    SELECT page_id AS item_id, local_path FROM {STATUS_SQL} WHERE status = 'missing'
    ORDER BY page_id LIMIT 25""")
def path_missing(spark, sf):
    frame = resolved_pages(spark, sf).withColumns(
        {"rating_key": F.col("item_id").cast("string"), "title": F.lit("")})
    return paths.missing_sample(frame, 25).select("item_id", "local_path")


@query("unmapped_prefixes", """
    SELECT split_part(url, '/', 1) AS prefix, count(*) AS n, min(url) AS sample
    FROM pages GROUP BY 1""")
def unmapped_prefixes(spark, sf):
    """http and https share no directory, so each gets a row of its own."""
    return paths.unmapped_prefixes(
        page_items(spark, sf).withColumn("path_status", F.lit("unmapped")))


@query("unmapped_common", """
    SELECT CASE WHEN count(DISTINCT split_part(url, '/', 3)) = 1
                THEN min(regexp_replace(regexp_replace(url, '/[^/]*$', ''), '//', '/'))
                ELSE 'https:' END AS prefix, count(*) AS n, min(url) AS sample
    FROM pages WHERE starts_with(url, 'https:')""")
def unmapped_common(spark, sf):
    frame = page_items(spark, sf)
    return paths.unmapped_prefixes(frame.withColumn("path_status", F.when(
        F.col("source_path").startswith("https:"), "unmapped").otherwise("mapped")))


# ── merges ────────────────────────────────────────────────────────────────────


class Events(Provider):
    id = "events"
    facts = (measure("seen.view"), measure("seen.click"), measure("seen.signup"),
             measure("seen.purchase"), measure("seen.error"))


class Texts(Provider):
    id = "texts"
    applies_to = ("document",)
    facts = (text("doc.lang"), measure("doc.chars"), words("doc.tags"), flag("doc.toxic"))


EVENT_REGISTRY, TEXT_REGISTRY = Registry([Events()]), Registry([Texts()])
SPLIT = "TIMESTAMP '2024-01-16'"


def event_facts(spark, sf):
    """Per user and event type the latest value; later errors with a low value delete."""
    events = t.table(spark, sf, "events")
    rows = events.select(
        F.col("user_id").cast("string").alias("item_id"),
        F.concat(F.lit("seen."), F.col("event_type")).alias("key"),
        F.col("value").cast("string").alias("value"), F.lit("events").alias("provider"),
        F.col("event_id").alias("seq"), "ts",
        (F.expr(f"ts >= {SPLIT}") & (F.col("event_type") == "error") & (F.col("value") < 40))
        .alias("is_delete"))
    late = F.expr(f"ts >= {SPLIT}")
    return rows.filter(~late).drop("ts"), rows.filter(late).drop("ts")


MERGED_SQL = f"""(
    SELECT user_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r
        FROM events)
    WHERE r = 1 AND NOT (ts >= {SPLIT} AND event_type = 'error' AND value < 40))"""


@query("fact_merge", f"""
    SELECT CAST(user_id AS VARCHAR) AS item_id, 'seen.' || event_type AS key, value
    FROM {MERGED_SQL}""")
def fact_merge(spark, sf):
    return facts.merge(*event_facts(spark, sf)).select(
        "item_id", "key", F.col("value").cast("double").alias("value"))


@query("fact_table", f"""
    SELECT CAST(user_id AS VARCHAR) AS item_id, 'seen.' || event_type AS key, value
    FROM {MERGED_SQL}""")
def fact_table(spark, sf):
    """Two runs written to the fact table, the second one twice, and read back merged."""
    path = scratch(spark, "facts")
    early, late = event_facts(spark, sf)
    facts.write_patch(early, path, 1)
    facts.write_patch(late, path, 2)
    facts.write_patch(late, path, 2)
    return facts.read_merged(spark, path).select(
        "item_id", "key", F.col("value").cast("double").alias("value"))


@query("fact_widen", "SELECT CAST(user_id AS VARCHAR) AS item_id, " + ", ".join(
    f"max(value) FILTER (WHERE event_type = '{k}') AS \"{k}\""
    for k in ("view", "click", "signup", "purchase", "error")) + f" FROM {MERGED_SQL} GROUP BY 1")
def fact_widen(spark, sf):
    wide = facts.widen(facts.merge(*event_facts(spark, sf)), EVENT_REGISTRY)
    return wide.select("item_id", "seen.*")


def text_results(spark, sf):
    tags = F.filter(F.array("source", F.when(F.col("toxic") == 1, F.lit("toxic"))),
                    lambda x: x.isNotNull())
    return t.table(spark, sf, "documents").join(
        t.table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("item_id"),
        F.struct("lang", F.col("n_chars").cast("double").alias("chars"), tags.alias("tags"),
                 (F.col("toxic") == 1).alias("toxic")).alias("doc"))


@query("facts_to_long", f"""
    SELECT CAST(doc_id AS VARCHAR) AS item_id, count(*) AS n, string_agg(key, ',' ORDER BY key)
        AS keys FROM (
        SELECT doc_id, unnest(CASE WHEN toxic IS NULL THEN ['doc.chars', 'doc.lang', 'doc.tags']
            ELSE ['doc.chars', 'doc.lang', 'doc.tags', 'doc.toxic'] END) AS key FROM {t.DOCS_SQL})
    GROUP BY doc_id""")
def facts_to_long(spark, sf):
    long = facts.to_long(text_results(spark, sf), TEXT_REGISTRY.specs(), 1)
    return long.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"))


@query("facts_round_trip", f"""
    SELECT CAST(doc_id AS VARCHAR) AS item_id, lang, CAST(n_chars AS DOUBLE) AS chars,
           CASE WHEN toxic = 1 THEN source || ',toxic' ELSE source END AS tags, toxic = 1 AS toxic
    FROM {t.DOCS_SQL}""")
def facts_round_trip(spark, sf):
    long = facts.to_long(text_results(spark, sf), TEXT_REGISTRY.specs(), 1)
    return facts.widen(long, TEXT_REGISTRY).select(
        "item_id", "doc.lang", "doc.chars", F.array_join("doc.tags", ",").alias("tags"),
        "doc.toxic")


@query("facts_lay_over", f"""
    SELECT doc_id AS item_id, coalesce(CAST(quality * 10 AS DOUBLE), n_chars) AS chars, lang,
           toxic = 1 AS toxic FROM {t.DOCS_SQL}""")
def facts_lay_over(spark, sf):
    base = t.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.struct(F.col("n_chars").cast("double").alias("chars"), F.col("lang")).alias("doc"))
    newer = t.table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"),
        F.struct((F.col("quality") * 10).cast("double").alias("chars"),
                 F.lit(None).cast("string").alias("lang"),
                 (F.col("toxic") == 1).alias("toxic")).alias("doc"))
    return facts.lay_over(base, newer, ["doc"]).select(
        "item_id", "doc.chars", "doc.lang", "doc.toxic")


@query("prov_merge", """
    SELECT user_id AS item_id, event_type AS provider, props AS reason, event_id AS computed_at
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC)
          AS r FROM events) WHERE r = 1""")
def prov_merge(spark, sf):
    rows = t.table(spark, sf, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_type").alias("provider"),
        F.col("props").alias("reason"), F.col("event_id").alias("computed_at"), "ts")
    late = F.expr(f"ts >= {SPLIT}")
    return facts.merge_provenance(
        rows.filter(~late).drop("ts"), rows.filter(late).drop("ts"))


@query("fact_store_merge", f"""
    SELECT CAST(user_id AS VARCHAR) AS item_id, 'seen.' || event_type AS key, value
    FROM {MERGED_SQL}""")
def fact_store_merge(spark, sf):
    """Results laid over stored facts: only the results are moved."""
    early, late = event_facts(spark, sf)
    store = facts.fact_store(spark, scratch(spark, "facts"))
    store.put(early, 1)
    return store.merged(late).filter(~F.col("is_delete")).select(
        "item_id", "key", F.col("value").cast("double").alias("value"))


@query("prov_table", """
    SELECT user_id AS item_id, event_type AS provider, props AS reason, event_id AS computed_at
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC)
          AS r FROM events) WHERE r = 1""")
def prov_table(spark, sf):
    """The same rows from a stored table and a run laid over it."""
    rows = t.table(spark, sf, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_type").alias("provider"),
        F.col("props").alias("reason"), F.col("event_id").alias("computed_at"), "ts")
    late = F.expr(f"ts >= {SPLIT}")
    store = facts.provenance_store(
        spark, scratch(spark, "provenance"),
        "item_id bigint, provider string, reason string, computed_at bigint")
    store.put(rows.filter(~late), 1)
    return facts.merge_provenance(store, rows.filter(late))


# ── reconcile: orders before and after ────────────────────────────────────────
# Before: orders placed up to August 2000, those below 60,000 already deleted. After: all
# but the low-priority ones; urgent ones have a new key; the file of dear ones changed.
# The library is the order status, and only P and F are scanned.

BEFORE = "o_orderdate < TIMESTAMP '2000-08-01'"
AFTER = "o_orderpriority <> '5-LOW' AND o_orderstatus <> 'O'"
ROTATED, CHANGED, DEAD = ("o_orderpriority = '1-URGENT'", "o_totalprice > 300000",
                          "o_totalprice < 60000")
SHIFT = 10_000_000_000
RUN_AT, RUN_ID = 1000, 7


def before(spark, sf):
    return t.table(spark, sf, "orders").filter(BEFORE).select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("library_key"),
        F.col("o_orderkey").cast("string").alias("rating_key"),
        F.col("o_orderkey").cast("string").alias("guid"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("v1-"), F.col("o_orderkey")).alias("file_fp"),
        F.lit(1).cast("bigint").alias("first_seen"), F.lit(1).cast("bigint").alias("last_seen"),
        F.lit(1).cast("bigint").alias("seen_run"),
        F.expr(f"CASE WHEN {DEAD} THEN 5 END").cast("bigint").alias("deleted_at"),
        F.struct(F.col("o_totalprice").alias("price")).alias("order"))


def after(spark, sf):
    key = F.col("o_orderkey") + F.when(F.expr(ROTATED), SHIFT).otherwise(0)
    return t.table(spark, sf, "orders").filter(AFTER).select(
        F.col("o_orderstatus").alias("library_key"), key.cast("string").alias("rating_key"),
        F.col("o_orderkey").cast("string").alias("guid"),
        F.lower("o_orderpriority").alias("title"),
        F.concat(F.expr(f"CASE WHEN {CHANGED} THEN 'v2-' ELSE 'v1-' END"), F.col("o_orderkey"))
        .alias("file_fp"))


def reconciled(spark, sf):
    return reconcile.apply(before(spark, sf), after(spark, sf), ["P", "F"], RUN_AT, RUN_ID,
                           new_id=F.col("rating_key").cast("bigint"))


RECONCILED_SQL = f"""(
    SELECT *, {BEFORE} AS was, {AFTER} AS isin, {ROTATED} AS rotated, {CHANGED} AS changed,
           {BEFORE} AND {DEAD} AS dead, o_orderkey + CASE WHEN {ROTATED} THEN {SHIFT} ELSE 0 END
               AS new_key FROM orders WHERE ({BEFORE}) OR ({AFTER}))"""


@query("reconcile_rows", f"""
    SELECT CASE WHEN was THEN o_orderkey ELSE new_key END AS item_id, o_orderstatus AS library_key,
           CAST(CASE WHEN isin THEN new_key ELSE o_orderkey END AS VARCHAR) AS rating_key,
           CASE WHEN isin THEN lower(o_orderpriority) ELSE o_orderpriority END AS title,
           CASE WHEN isin AND changed THEN 'v2-' ELSE 'v1-' END || o_orderkey AS file_fp,
           CAST(CASE WHEN was THEN 1 ELSE {RUN_AT} END AS BIGINT) AS first_seen,
           CAST(CASE WHEN isin THEN {RUN_AT} ELSE 1 END AS BIGINT) AS last_seen,
           CAST(CASE WHEN isin THEN {RUN_ID} ELSE 1 END AS BIGINT) AS seen_run,
           CAST(CASE WHEN isin THEN NULL WHEN dead THEN 5 WHEN o_orderstatus <> 'O' THEN {RUN_AT}
                END AS BIGINT) AS deleted_at,
           CASE WHEN was THEN o_totalprice END AS price
    FROM {RECONCILED_SQL}""")
def reconcile_rows(spark, sf):
    return reconciled(spark, sf)[0].select(
        "item_id", "library_key", "rating_key", "title", "file_fp", "first_seen", "last_seen",
        "seen_run", "deleted_at", "order.price")


@query("reconcile_counts", f"""
    SELECT count(*) FILTER (WHERE isin) AS seen, count(*) FILTER (WHERE isin AND NOT was) AS added,
           count(*) FILTER (WHERE isin AND was AND NOT rotated) AS updated,
           count(*) FILTER (WHERE isin AND was AND rotated) AS rotated,
           count(*) FILTER (WHERE NOT isin AND was AND NOT dead AND o_orderstatus <> 'O') AS removed,
           count(*) FILTER (WHERE isin AND dead) AS resurrected,
           count(*) FILTER (WHERE isin AND was AND changed) AS changed_files
    FROM {RECONCILED_SQL}""")
def reconcile_counts(spark, sf):
    return reconciled(spark, sf)[1]


def reconciled_once(spark, sf):
    items = before(spark, sf).withColumn("item_type", F.lit("order"))
    return reconcile.store(items, after(spark, sf), ["P", "F"], RUN_AT, RUN_ID, scratch(spark, "catalogue"),
                           new_id=F.col("rating_key").cast("bigint"))


@query("reconcile_stored", ORACLES["reconcile_rows"])
def reconcile_stored(spark, sf):
    """The catalogue as it is written, with its counts observed on the way."""
    return reconciled_once(spark, sf)[0].select(
        "item_id", "library_key", "rating_key", "title", "file_fp", "first_seen", "last_seen",
        "seen_run", "deleted_at", "order.price")


@query("reconcile_observed", ORACLES["reconcile_counts"])
def reconcile_observed(spark, sf):
    """The counts that were observed while the catalogue was written."""
    counts = reconciled_once(spark, sf)[1]
    return spark.range(1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()])


# ── staleness ─────────────────────────────────────────────────────────────────


class DocText(Provider):
    """Reads documents; English ones shorter than 50 characters cannot be read."""

    id = "doctext"
    schema_version = 2
    max_age_s = 600
    applies_to = ("en", "fr", "de")
    facts = (measure("doctext.chars"),)

    def selector(self):
        return F.col("n_chars") > 10

    def ineligible(self):
        return F.when((F.col("item_type") == "en") & (F.col("n_chars") < 400),
                      F.concat(F.lit("too short: "), F.col("item_type")))

    def fingerprint(self):
        return F.when(F.col("source") != "src3", F.sha1("text"))

    def compute(self, items, sources):
        return self.results(items, {"doctext.chars": F.length("text")},
                            F.when(F.length("text") > 0, "ok").otherwise("error"),
                            F.lit("empty"))


NOW = 10_000


def stale_inputs(spark, sf):
    items = t.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("item_type"), "n_chars", "source",
        "text", F.when(F.col("source") == "src9", 1).cast("bigint").alias("deleted_at"))
    prov = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("item_id"), F.lit("doctext").alias("provider"),
        F.when(F.col("source") == "src5", 1).otherwise(2).alias("schema_version"),
        F.when(F.col("source") != "src7", F.sha1("text")).alias("input_fp"),
        (NOW - F.when(F.col("quality") == 1, 599).otherwise(600)).cast("bigint")
        .alias("computed_at"),
        F.when(F.col("toxic") == 1, "error").when(F.col("source") == "src11", "skipped")
        .otherwise("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
    return items, prov


STALE_SQL = f"""(
    SELECT *, CASE WHEN source <> 'src3' THEN sha1(text) END AS fp FROM {t.DOCS_SQL}
    WHERE source <> 'src9' AND n_chars > 10 AND lang IN ('en', 'fr', 'de') AND (
        quality IS NULL OR source = 'src5' OR toxic = 1 OR source = 'src11'
        OR source = 'src7' OR quality <> 1))"""


@query("stale_plan", f"SELECT doc_id AS item_id, fp AS input_fp FROM {STALE_SQL}")
def stale_plan(spark, sf):
    return staleness.stale(*stale_inputs(spark, sf), DocText(), NOW).select(
        "item_id", "input_fp")


@query("stale_stored", f"SELECT doc_id AS item_id, fp AS input_fp FROM {STALE_SQL}")
def stale_stored(spark, sf):
    """The same plan against provenance on disk, which stays in its buckets."""
    items, provenance = stale_inputs(spark, sf)
    kinds = ", ".join(f"{name} {kind}" for name, kind in provenance.dtypes)
    store = facts.provenance_store(spark, scratch(spark, "provenance"), kinds)
    store.put(provenance, 1)
    return staleness.stale(items, store.merged(), DocText(), NOW).select("item_id", "input_fp")


@query("stale_forced", """
    SELECT doc_id AS item_id FROM documents
    WHERE source <> 'src9' AND n_chars > 10 AND lang IN ('en', 'fr', 'de')""")
def stale_forced(spark, sf):
    return staleness.stale(*stale_inputs(spark, sf), DocText(), NOW, force=True).select("item_id")


@query("eligible_split", f"""
    SELECT doc_id AS item_id, CASE WHEN lang = 'en' AND n_chars < 400 THEN 'skipped' ELSE 'due' END
        AS status, CASE WHEN lang = 'en' AND n_chars < 400 THEN 'too short: en' END AS reason
    FROM {STALE_SQL}""")
def eligible_split(spark, sf):
    due = staleness.stale(*stale_inputs(spark, sf), DocText(), NOW)
    good, skipped = staleness.split_eligible(due, DocText())
    return good.select("item_id", F.lit("due").alias("status"),
                       F.lit(None).cast("string").alias("reason")).unionByName(
        skipped.select("item_id", "status", "reason"))


def held(spark):
    """Stores a frame and gives the table back."""
    def hold(frame):
        path = scratch(spark, "held")
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)
    return hold


class DocSize(Provider):
    """Depends on what ``DocText`` has found."""

    id = "docsize"
    depends_on = ("doctext",)
    applies_to = ("en", "fr", "de")
    facts = (flag("docsize.long"),)

    def ineligible(self):
        return F.when(F.col("doctext.chars").isNull(), "not read")

    def compute(self, items, sources):
        return self.results(items, {"docsize.long": F.col("doctext.chars") > 1000})


READ = "(due IS NOT NULL AND NOT (lang = 'en' AND n_chars < 400))"


@query("scan_all", f"""
    SELECT doc_id AS item_id, CASE WHEN {READ} THEN CAST(length(text) AS DOUBLE) END AS chars,
           CASE WHEN {READ} THEN length(text) > 1000 END AS long,
           CASE WHEN due IS NULL THEN CASE WHEN known THEN
                    CASE WHEN toxic = 1 THEN 'error' WHEN source = 'src11' THEN 'skipped' ELSE 'ok' END END
                WHEN {READ} THEN 'ok' ELSE 'skipped' END AS text_status,
           CASE WHEN source <> 'src9' AND lang IN ('en', 'fr', 'de') THEN
                CASE WHEN {READ} THEN 'ok' ELSE 'skipped' END END AS size_status
    FROM (SELECT d.*, l.toxic, l.doc_id IS NOT NULL AS known, s.doc_id AS due FROM documents d
          LEFT JOIN labels l USING (doc_id) LEFT JOIN {STALE_SQL} s USING (doc_id))""")
def scan_all(spark, sf):
    """Two providers in the order of their dependency, given the other way round."""
    items, prov = stale_inputs(spark, sf)
    hold = held(spark)
    done, provenance = staleness.run_all(
        items, prov, [DocSize(), DocText()], {}, NOW, lambda _, results: hold(results), hold=hold)
    status = provenance.groupBy("item_id").agg(*[
        F.max(F.when(F.col("provider") == name, F.col("status"))).alias(column)
        for name, column in (("doctext", "text_status"), ("docsize", "size_status"))])
    return done.select("item_id", "doctext.chars", "docsize.long").join(status, "item_id", "left")


@query("scan_run", f"""
    SELECT doc_id AS item_id, CASE WHEN lang = 'en' AND n_chars < 400 THEN 'skipped' ELSE 'ok' END
        AS status, fp AS input_fp,
        CASE WHEN NOT (lang = 'en' AND n_chars < 400) THEN CAST(length(text) AS DOUBLE) END AS chars
    FROM {STALE_SQL}""")
def scan_run(spark, sf):
    """Plan, split and compute in one go."""
    items, prov = stale_inputs(spark, sf)
    return staleness.run(items, prov, DocText(), {}, NOW, hold=held(spark)).select(
        "item_id", "status", "input_fp", "doctext.chars")


@query("input_fp", f"""
    SELECT doc_id AS item_id, sha1(concat_ws('|', coalesce(CAST(quality AS VARCHAR), 'None'),
        coalesce(CAST(toxic AS VARCHAR), 'None'), lang, CAST(n_chars AS VARCHAR), text)) AS fp
    FROM {t.DOCS_SQL}""")
def input_fp(spark, sf):
    docs = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(F.col("doc_id").alias("item_id"), staleness.input_fingerprint(
        *[F.col(c) for c in ("quality", "toxic", "lang", "n_chars", "text")]).alias("fp"))
