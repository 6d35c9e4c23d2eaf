"""Rollups, watch history, value lists, coverage and other counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.joins import left_lookup
from factloom.functions.spec import text
from factloom.operators import browse, report
from factloom.operators.providers import History, Provider, Rollup
from factloom.operators.providers.derived import resolution_class
from factloom.operators.providers.rollup import (
    children_by_parent, keep_up, kept_totals, totals_store, touched_parents, union_of_lists)
from factloom.streaming import refresh

from . import tables as t
from .base import ORACLES, query, scratch

# ── parents and children: orders and their lines ──────────────────────────────

CHILDREN_SQL = """(
    SELECT l_orderkey AS k, l_quantity * 1000000 AS size, l_quantity * 60 AS secs,
           l_quantity * 100 AS rate, l_linestatus AS hdr, l_returnflag AS flag,
           CASE WHEN l_quantity * 80 >= 3000 THEN '4k' WHEN l_quantity * 80 >= 1800 THEN '1080p'
                WHEN l_quantity * 80 >= 1200 THEN '720p' ELSE 'sd' END AS res
    FROM lineitem)"""


def children(spark, sf):
    quantity = F.col("l_quantity")
    return t.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("parent_key"),
        F.lit("episode").alias("item_type"), F.lit(None).cast("bigint").alias("deleted_at"),
        (quantity * 1_000_000).cast("bigint").alias("file_size"),
        F.struct((quantity * 60).alias("duration_s"),
                 (quantity * 100).alias("bitrate_kbps")).alias("file"),
        F.struct(resolution_class(quantity * 80).alias("resolution_class")).alias("derived"),
        F.struct(F.col("l_linestatus").alias("hdr_format"),
                 F.col("l_returnflag").alias("aspect_bucket")).alias("video"),
        F.struct(F.array("l_returnflag", "l_linestatus").alias("languages")).alias("audio"))


def parents(spark, sf):
    return t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").cast("string").alias("rating_key"),
        (F.col("o_custkey") % 13).cast("int").alias("leaf_count"),
        (F.col("o_custkey") % 5).cast("int").alias("viewed_leaf_count"))


def joined(name):
    return F.array_join(name, ",")


def texts(value):
    return f"array_to_string(list_sort(list(DISTINCT {value})), ',')"


@query("rollup_basic", f"""
    SELECT k AS order_key, count(*) AS episodes, CAST(sum(size) AS BIGINT) AS size,
           sum(secs) AS seconds, min(rate) AS min_rate, max(rate) AS max_rate,
           round(avg(rate), 4) AS mean_rate, {texts('res')} AS resolutions, {texts('hdr')} AS hdr,
           {texts('flag')} AS aspects
    FROM {CHILDREN_SQL} GROUP BY k""")
def rollup_basic(spark, sf):
    return children_by_parent(children(spark, sf)).select(
        F.col("parent_key").cast("bigint").alias("order_key"), "episodes", "size", "seconds",
        "min_rate", "max_rate", F.round("mean_rate", 4).alias("mean_rate"),
        joined("resolutions").alias("resolutions"), joined("hdr").alias("hdr"),
        joined("aspects").alias("aspects"))


@query("rollup_languages", f"""
    SELECT k AS order_key, {texts('v')} AS languages FROM (
        SELECT k, flag AS v FROM {CHILDREN_SQL} UNION ALL SELECT k, hdr FROM {CHILDREN_SQL})
    GROUP BY k""")
def rollup_languages(spark, sf):
    return union_of_lists(children(spark, sf), "parent_key", "audio.languages", "languages").select(
        F.col("parent_key").cast("bigint").alias("order_key"),
        joined("languages").alias("languages"))


def kept_up(spark, sf):
    """Totals that were stored when returned lines had no size yet and open ones had other orders."""
    now = children(spark, sf)
    resized, moved = F.col("video.aspect_bucket") == "R", F.col("video.hdr_format") == "O"
    before = now.withColumns({
        "file_size": F.when(resized, F.lit(0)).otherwise(F.col("file_size")),
        "parent_key": F.when(moved, F.concat(F.lit("-"), "parent_key")).otherwise(F.col("parent_key"))})
    store = totals_store(spark, scratch(spark, "rollup"))
    keep_up(store, before, touched_parents(before), 1)
    changed = resized | moved
    keep_up(store, now, touched_parents(before.filter(changed), now.filter(changed)), 2)
    return kept_totals(store)


@query("rollup_kept_up", f"""
    SELECT * FROM ({ORACLES['rollup_basic']}) JOIN ({ORACLES['rollup_languages']})
    USING (order_key)""")
def rollup_kept_up(spark, sf):
    """Stored totals after a change of some children: touched parents anew, emptied ones gone."""
    return kept_up(spark, sf).select(
        F.col("parent_key").cast("bigint").alias("order_key"), "episodes", "size", "seconds",
        "min_rate", "max_rate", F.round("mean_rate", 4).alias("mean_rate"),
        *[joined(c).alias(c) for c in ("resolutions", "hdr", "aspects", "languages")])


def rolled(spark, sf):
    return Rollup().compute(parents(spark, sf), {"children": children(spark, sf)})


ROLLED_SQL = f"""(
    SELECT o_orderkey, o_custkey % 13 AS leaf, o_custkey % 5 AS viewed, r.* FROM orders LEFT JOIN (
        SELECT k, count(*) AS n, sum(size) AS size, sum(secs) AS secs,
               list_sort(list(DISTINCT res)) AS res, list_sort(list(DISTINCT hdr)) AS hdr,
               count(*) FILTER (WHERE starts_with(hdr, 'dv')) AS dv
        FROM {CHILDREN_SQL} GROUP BY k) r ON r.k = o_orderkey)"""


@query("rollup_flags", f"""
    SELECT o_orderkey AS item_id, CASE WHEN leaf = 0 AND n IS NULL THEN 'skipped' ELSE 'ok' END
             AS status,
           CAST(n AS DOUBLE) AS episode_count, round(size / 1000000 / n, 1) AS size_per_episode_mb,
           round(secs / 60, 1) AS total_runtime_min, len(res) > 1 AS mixed_resolutions,
           res = ['4k'] AS all_4k, list_contains(res, '4k') AS any_4k, len(hdr) > 1 AS mixed_hdr,
           dv > 0 AS any_dolby_vision,
           CASE WHEN list_contains(res, 'sd') THEN 'sd' WHEN list_contains(res, '720p') THEN '720p'
                WHEN list_contains(res, '1080p') THEN '1080p' WHEN list_contains(res, '4k')
                THEN '4k' END AS worst_resolution
    FROM {ROLLED_SQL}""")
def rollup_flags(spark, sf):
    names = ["episode_count", "size_per_episode_mb", "total_runtime_min", "mixed_resolutions",
             "all_4k", "any_4k", "mixed_hdr", "any_dolby_vision", "worst_resolution"]
    return rolled(spark, sf).select("item_id", "status", *[f"show.{n}" for n in names])


@query("progress", """
    SELECT o_orderkey AS item_id, CAST(nullif(leaf, 0) AS DOUBLE) AS leaf_count,
           CASE WHEN leaf > 0 THEN round(viewed / leaf * 100, 1) END AS percent_watched,
           CASE WHEN leaf > 0 THEN viewed = 0 END AS unwatched,
           CASE WHEN leaf > 0 THEN round(viewed / leaf * 100, 1) > 0
                AND round(viewed / leaf * 100, 1) < 90 END AS abandoned
    FROM (SELECT o_orderkey, o_custkey % 13 AS leaf, o_custkey % 5 AS viewed FROM orders)""")
def progress(spark, sf):
    return rolled(spark, sf).select(
        "item_id", "show.leaf_count", "show.percent_watched", "show.unwatched", "show.abandoned")


@query("rollup_join", f"""
    SELECT o_orderkey AS item_id, coalesce(array_to_string(hdr, ','), 'unknown') AS hdr
    FROM {ROLLED_SQL}""")
def rollup_join(spark, sf):
    return rolled(spark, sf).select(
        "item_id", F.coalesce(joined("show.hdr_formats"), F.lit("unknown")).alias("hdr"))


# ── watch history: customers and their events ─────────────────────────────────

WATCH_SQL = """
    SELECT user_id, count(*) AS plays, CAST(max(floor(epoch(ts))) AS BIGINT) AS last,
           count(DISTINCT json_extract_string(props, '$.k')) AS users,
           count(*) FILTER (WHERE event_type = 'purchase') AS completed
    FROM events WHERE user_id IS NOT NULL GROUP BY user_id"""
WATCH_FACTS_SQL = f"""
    SELECT c_custkey AS item_id, CAST(coalesce(plays, 0) AS DOUBLE) AS play_count,
           last AS last_played, plays IS NULL AS never_played,
           CAST(coalesce(users, 0) AS DOUBLE) AS unique_users,
           CAST(coalesce(completed, 0) AS DOUBLE) AS completed_count,
           plays IS NOT NULL AND completed = 0 AS abandoned
    FROM customer LEFT JOIN ({WATCH_SQL}) ON user_id = c_custkey"""


@query("watch_facts", WATCH_FACTS_SQL)
def watch_facts(spark, sf):
    done = History().compute(t.customers(spark, sf), {"history": t.history(spark, sf)})
    return done.select("item_id", "watch.*")


@query("watch_left_join", f"""
    SELECT c_custkey AS item_id, coalesce(plays, 0) AS plays FROM customer
    LEFT JOIN ({WATCH_SQL}) ON user_id = c_custkey""")
def watch_left_join(spark, sf):
    totals = t.history(spark, sf).groupBy("rating_key").agg(F.count(F.lit(1)).alias("plays"))
    return left_lookup(t.customers(spark, sf), totals, ["rating_key"], "item_id").select(
        "item_id", F.coalesce("plays", F.lit(0)).alias("plays"))


@query("refresh_equals_batch", WATCH_FACTS_SQL)
def refresh_equals_batch(spark, sf):
    """The events read as a stream, reduced batch by batch into the state table."""
    folder = scratch(spark, "refresh")
    schema = t.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option(
        "maxFilesPerTrigger", 1).parquet(sf)
    source = stream.select(
        F.col("user_id").cast("string").alias("rating_key"),
        t.seconds(stream, "ts").alias("date"), F.lit(None).cast("bigint").alias("stopped"),
        F.get_json_object("props", "$.k").alias("user"),
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("watched_status"))
    state = f"{folder}/state"
    refresh.start(source, state, f"{folder}/marks").awaitTermination()
    done = History().from_totals(t.customers(spark, sf), refresh.totals(spark, state))
    return done.select("item_id", "watch.*")


@query("running_totals", WATCH_FACTS_SQL)
def running_totals(spark, sf):
    """The events in three batches by time, which share items and users; the last one taken twice."""
    history = t.history(spark, sf)
    first, second = F.col("date") < t.at("2024-01-11"), F.col("date") < t.at("2024-01-21")
    running = refresh.RunningTotals.open(spark, scratch(spark, "running"))
    running.take(history.filter(first), 0)
    running.take(history.filter(~first & second), 1)
    rest = history.filter(~F.coalesce(second, F.lit(False)))
    running.take(rest, 2)
    running.take(rest, 2)
    done = History().from_totals(t.customers(spark, sf), running.totals())
    return done.select("item_id", "watch.*")


# ── values a fact takes ───────────────────────────────────────────────────────


@query("typeahead", """
    SELECT p_name AS value, count(*) AS n FROM part WHERE contains(lower(p_name), 'bo')
    GROUP BY p_name ORDER BY n DESC, value LIMIT 25""")
def typeahead(spark, sf):
    return browse.values(t.parts(spark, sf), t.REGISTRY.require("part.name"), "BO", 25)


@query("typeahead_number", """
    SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part
    WHERE contains(CAST(p_size AS VARCHAR), '1') GROUP BY p_size
    ORDER BY n DESC, p_size LIMIT 10""")
def typeahead_number(spark, sf):
    return browse.values(t.parts(spark, sf), t.REGISTRY.require("part.size"), "1", 10)


@query("typeahead_flag", f"""
    SELECT CAST(toxic AS VARCHAR) AS value, count(*) AS n FROM {t.DOCS_SQL}
    WHERE toxic IS NOT NULL GROUP BY toxic""")
def typeahead_flag(spark, sf):
    return browse.values(t.documents(spark, sf), t.REGISTRY.require("label.toxic"))


@query("typeahead_list", f"""
    SELECT value, count(*) AS n FROM (SELECT unnest(big_flags) AS value FROM {t.ORDERS_SQL})
    GROUP BY value ORDER BY n DESC, value LIMIT 50""")
def typeahead_list(spark, sf):
    return browse.values(t.orders(spark, sf), t.REGISTRY.require("order.big_flags"), limit=50)


@query("typeahead_vocab", """
    WITH seen AS (SELECT event_type AS value, count(*) AS n FROM events
                  WHERE contains(event_type, 'r') GROUP BY 1)
    SELECT * FROM (
        SELECT value, n FROM seen UNION ALL
        SELECT DISTINCT c_mktsegment, 0 FROM customer WHERE contains(lower(c_mktsegment), 'r')
          AND lower(c_mktsegment) NOT IN (SELECT lower(value) FROM seen))
    ORDER BY n DESC, value LIMIT 6""")
def typeahead_vocab(spark, sf):
    seen = t.table(spark, sf, "events").select(
        F.lit(None).cast("bigint").alias("deleted_at"),
        F.struct(F.col("event_type").alias("kind")).alias("event"))
    vocabulary = t.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("value"))
    return browse.values(seen, text("event.kind"), "r", 6, vocabulary)


@query("unnest", f"""
    SELECT o_orderkey AS item_id, unnest(flags) AS flag FROM {t.ORDERS_SQL}""")
def unnest(spark, sf):
    return t.orders(spark, sf).select("item_id", F.explode("order.flags").alias("flag"))


# ── coverage and counts ───────────────────────────────────────────────────────


class ByLabel(Provider):
    id = "labels"
    applies_to = ("en", "fr")


class ByFile(Provider):
    id = "chars"
    applies_to = ()
    file_fingerprinted = True


class Idle(Provider):
    id = "idle"
    applies_to = ("pt",)


def coverage_items(spark, sf):
    return t.documents(spark, sf).withColumns({
        "item_type": F.col("lang"), "deleted_at": F.when(F.col("doc.chars") > 5000, 1),
        "file_fp": F.when(F.col("lang") != "es", F.col("doc.source"))})


def coverage_provenance(spark, sf):
    labels = t.table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"), F.lit("labels").alias("provider"),
        F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "ok")
        .otherwise("skipped").alias("status"), F.lit("x").alias("input_fp"))
    chars = t.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.lit("chars").alias("provider"),
        F.lit("ok").alias("status"), F.lit("src1").alias("input_fp"))
    gone = labels.withColumn("provider", F.lit("removed"))
    return labels.unionByName(chars).unionByName(gone)


COVERAGE_SQL = """
    WITH live AS (SELECT doc_id, lang, CASE WHEN lang <> 'es' THEN source END AS file_fp
                  FROM documents WHERE n_chars <= 5000),
    prov AS (
        SELECT doc_id, 'labels' AS provider, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 1
               THEN 'ok' ELSE 'skipped' END AS status FROM labels
        UNION ALL SELECT doc_id, 'chars', 'ok' FROM documents),
    done AS (
        SELECT provider, lang, count(*) FILTER (WHERE status = 'ok') AS known,
               count(*) FILTER (WHERE status = 'error') AS errors,
               count(*) FILTER (WHERE status = 'skipped') AS skipped,
               count(*) FILTER (WHERE provider = 'chars' AND file_fp <> 'src1') AS stale
        FROM prov JOIN live USING (doc_id) GROUP BY 1, 2),
    totals AS (
        SELECT provider, lang, count(*) AS total
        FROM live JOIN (VALUES ('labels'), ('chars')) p(provider)
          ON provider = 'chars' OR lang IN ('en', 'fr') GROUP BY 1, 2),
    whole AS (
        SELECT provider, NULL AS item_type, total, known, errors, skipped, stale FROM
            (VALUES ('labels'), ('chars'), ('idle')) p(provider) LEFT JOIN
            (SELECT provider, sum(total) AS total FROM totals GROUP BY 1) USING (provider) LEFT JOIN
            (SELECT provider, sum(known) AS known, sum(errors) AS errors, sum(skipped) AS skipped,
                    sum(stale) AS stale FROM done GROUP BY 1) USING (provider)),
    by_type AS (SELECT provider, lang AS item_type, total, known, errors, skipped, stale
                FROM totals LEFT JOIN done USING (provider, lang))
    SELECT provider, item_type, CAST(coalesce(total, 0) AS BIGINT) AS total,
           CAST(coalesce(known, 0) AS BIGINT) AS known, CAST(coalesce(errors, 0) AS BIGINT) AS errors,
           CAST(coalesce(skipped, 0) AS BIGINT) AS skipped, CAST(coalesce(stale, 0) AS BIGINT) AS stale
    FROM (SELECT * FROM whole UNION ALL SELECT * FROM by_type)"""


@query("coverage", COVERAGE_SQL)
def coverage(spark, sf):
    return report.coverage(coverage_items(spark, sf), coverage_provenance(spark, sf),
                           [ByLabel(), ByFile(), Idle()]).select(
        "provider", "item_type", "total", "known", "errors", "skipped", "stale")


@query("registry_coverage", """
    SELECT key, type, provider, n_operators, known FROM (VALUES
        ('doc.chars', 'number', 'documents', 11), ('doc.lang', 'enum', 'documents', 6),
        ('doc.source', 'string', 'documents', 10), ('label.quality', 'number', 'labels', 11),
        ('label.toxic', 'bool', 'labels', 4)) f(key, type, provider, n_operators)
    JOIN (SELECT 'labels' AS provider, count(*) FILTER (WHERE toxic <> 1) AS known FROM labels
          UNION ALL SELECT 'documents', 0) USING (provider)""")
def registry_coverage(spark, sf):
    """Every fact of the documents with what may be asked of it and how many are known."""
    providers = [t.Documents(), t.Labels()]
    prov = t.table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"), F.lit("labels").alias("provider"),
        F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"),
        F.lit(None).cast("string").alias("input_fp"))
    docs = t.documents(spark, sf).withColumn("file_fp", F.lit(None).cast("string"))
    known = report.coverage(docs, prov, providers).filter("item_type IS NULL").select(
        "provider", "known")
    described = t.REGISTRY.describe_df(spark).select(
        "key", "type", "provider", F.size("operators").alias("n_operators"))
    return described.join(known, "provider").select(
        "key", "type", "provider", "n_operators", "known")


@query("stats", """
    SELECT lang AS path_status, count(*) FILTER (WHERE coalesce(toxic, 0) <> 1) AS total,
           count(*) FILTER (WHERE coalesce(toxic, 0) <> 1 AND quality IS NOT NULL) AS with_facts,
           count(*) FILTER (WHERE toxic = 1) AS deleted
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def stats(spark, sf):
    frame = t.documents(spark, sf).withColumns({
        "path_status": F.col("lang"), "deleted_at": F.when(F.col("label.toxic"), 1)})
    return report.stats(frame, F.col("label.quality").isNotNull())


@query("run_outcome", """
    SELECT event_type AS provider, count(*) FILTER (WHERE value >= 5) AS eligible,
           count(*) FILTER (WHERE value >= 20) AS ok,
           count(*) FILTER (WHERE value >= 5 AND value < 20) AS errors,
           count(*) FILTER (WHERE value < 5) AS skipped,
           arg_min(props, event_id) FILTER (WHERE value < 5) AS skip_reason
    FROM events GROUP BY event_type""")
def run_outcome(spark, sf):
    results = t.table(spark, sf, "events").select(
        F.col("event_id").alias("item_id"), F.col("event_type").alias("provider"),
        F.when(F.col("value") < 5, "skipped").when(F.col("value") < 20, "error")
        .otherwise("ok").alias("status"), F.col("props").alias("reason"))
    return report.run_outcome(results)


@query("published_counts", """
    SELECT n_nationkey AS rule_id, count(c_custkey) AS published FROM nation
    LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY') ON c_nationkey = n_nationkey
    GROUP BY 1""")
def published_counts(spark, sf):
    rules = t.table(spark, sf, "nation").select(F.col("n_nationkey").alias("rule_id"))
    members = t.table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(
        F.col("c_nationkey").alias("rule_id"))
    return report.published_counts(rules, members)


@query("published_counts_whole", """
    SELECT rule_id, count(c_custkey) AS published
    FROM (SELECT n_nationkey AS rule_id FROM nation UNION ALL SELECT n_nationkey + 1000 FROM nation)
    LEFT JOIN customer ON c_nationkey = rule_id GROUP BY 1""")
def published_counts_whole(spark, sf):
    """All customers; the rules without members are ids that no customer has."""
    rules = t.table(spark, sf, "nation").select(F.explode(F.array(
        F.col("n_nationkey"), F.col("n_nationkey") + 1000)).alias("rule_id"))
    members = t.table(spark, sf, "customer").select(F.col("c_nationkey").alias("rule_id"))
    return report.published_counts(rules, members)
