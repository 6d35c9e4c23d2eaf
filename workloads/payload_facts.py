"""Provider facts from JSON payloads and from other facts.

The payloads are written by Spark from rows of the given tables, then read by the
providers; the SQL computes the same facts straight from the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.joins import resolve_names
from factloom.operators.providers import Derived, Film, Identity, MovieMgmt, Probe, SeriesMgmt
from factloom.operators.providers import derived
from factloom.operators.providers.probe import RATIOS, TOLERANCE, rate_of, ratio_bucket, ratio_of

from . import tables as t
from .base import ORACLES, query


def as_json(**fields):
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def listed(column):
    return F.array_join(column, ",")


# ── identity: orders as catalogue rows ────────────────────────────────────────


@query("identity_facts", """
    SELECT o_orderkey AS item_id, o_orderpriority AS title, CAST(year(o_orderdate) AS DOUBLE) AS year,
           CAST(epoch(o_orderdate) AS BIGINT) AS added_at,
           CASE WHEN o_custkey <> 0 THEN o_custkey END AS updated_at,
           CASE WHEN o_custkey <> 0 THEN round(o_custkey * 1000 / 60000, 2) END AS duration_min,
           o_orderstatus = 'P' AS has_tmdb_id FROM orders""")
def identity_facts(spark, sf):
    orders = t.table(spark, sf, "orders")
    items = orders.select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("title"),
        F.year("o_orderdate").alias("year"), t.seconds(orders, "o_orderdate").alias("added_at"),
        F.col("o_custkey").alias("updated_at"),
        (F.col("o_custkey") * 1000).alias("duration_ms"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")).alias("tmdb_id"))
    return Identity().compute(items, {}).select("item_id", "plex.*")


# ── film metadata: parts ──────────────────────────────────────────────────────


def film_payloads(spark, sf, whole=False):
    part = t.table(spark, sf, "part").filter("true" if whole else "p_type <> 'ECONOMY'")
    size, price = F.col("p_size"), F.col("p_retailprice")
    return part.select(
        (F.col("p_partkey") + 1).alias("tmdb_id"),
        as_json(
            runtime=size - 5, budget=F.when(size > 10, (price * 1000).cast("bigint")),
            revenue=(size * 50000).cast("bigint"), vote_average=size / 8,
            vote_count=size * 3, original_language=F.lower(F.substring("p_type", 1, 2)),
            release_date=F.concat(F.lit("20"), F.lpad(size.cast("string"), 2, "0"), F.lit("-02-03")),
            adult=F.when(size > 25, size > 40), tagline=F.lit(""),
            belongs_to_collection=F.when(size < 20, F.struct(F.col("p_brand").alias("name"))),
            genres=F.array(F.struct(F.col("p_type").alias("name")),
                           F.struct(F.lit(None).cast("string").alias("name"))),
            keywords=F.struct(F.transform(
                F.split(F.concat(F.upper("p_name"), F.lit(" "), F.col("p_name")), " "),
                lambda w: F.struct(w.alias("name"))).alias("keywords")),
        ).alias("payload"))


def part_items(spark, sf, whole=False):
    """With whole tables some items have ids that do not exist, else payloads are left out."""
    key = F.col("p_partkey") + 1
    return t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.when(F.col("p_size") != 9, unknown_at(7, F.col("p_partkey"), key) if whole else key)
        .alias("tmdb_id"))


def unknown_at(n, number, key):
    """The key, but for every n-th number one that no row has."""
    return F.when(number % n == 0, -key).otherwise(key)


PRESENT = "(p_size <> 9 AND p_type <> 'ECONOMY')"
PRESENT_WHOLE = "(p_size <> 9 AND p_partkey % 7 <> 0)"


@query("film_facts", f"""
    SELECT p_partkey AS item_id, CASE WHEN {PRESENT} THEN 'ok' ELSE 'error' END AS status,
        CASE WHEN {PRESENT} THEN array_to_string(list_sort(string_split(p_name, ' ')), ',') END
            AS keywords,
        CASE WHEN {PRESENT} AND p_size < 20 THEN p_brand END AS collection,
        CASE WHEN {PRESENT} AND p_size <> 5 THEN CAST(p_size - 5 AS DOUBLE) END AS runtime,
        CASE WHEN {PRESENT} THEN CAST(CASE WHEN p_size > 10 THEN trunc(p_retailprice * 1000)
            ELSE 0 END AS DOUBLE) END AS budget,
        CASE WHEN {PRESENT} AND p_size > 10
            THEN round(p_size * 50000 / trunc(p_retailprice * 1000), 3) END AS roi,
        CASE WHEN {PRESENT} THEN round(p_size / 8, 2) END AS vote_average,
        CASE WHEN {PRESENT} THEN lower(p_type[1:2]) END AS original_language,
        CASE WHEN {PRESENT} THEN p_type END AS genres,
        CASE WHEN {PRESENT} THEN CAST(epoch(make_date(2000 + p_size, 2, 3)) AS BIGINT) END
            AS release_date,
        CASE WHEN {PRESENT} THEN p_size > 40 END AS adult,
        CAST(NULL AS VARCHAR) AS tagline
    FROM part""")
def film_facts(spark, sf, whole=False):
    done = Film().compute(part_items(spark, sf, whole), {"films": film_payloads(spark, sf, whole)})
    names = ["collection", "runtime", "budget", "roi", "vote_average", "original_language",
             "release_date", "adult", "tagline"]
    return done.select("item_id", "status", listed("tmdb.keywords").alias("keywords"),
                       listed("tmdb.genres").alias("genres"), *[f"tmdb.{n}" for n in names])


@query("film_facts_whole", ORACLES["film_facts"].replace(PRESENT, PRESENT_WHOLE))
def film_facts_whole(spark, sf):
    return film_facts(spark, sf, whole=True)


# ── movie automation: parts again, with nations as tags and regions as profiles ─


def vocabulary(spark, sf, name, key, value):
    return t.table(spark, sf, name).select(
        F.col(key).cast("bigint").alias("id"), F.col(value).alias("name"))


def movie_sources(spark, sf, whole=False):
    part = t.table(spark, sf, "part").filter("true" if whole else "p_type <> 'ECONOMY'")
    size = F.col("p_size")
    key = F.col("p_partkey") + 1

    def detail(score, repack, edition):
        return F.struct(
            key.alias("id"), edition.alias("edition"), F.col("p_brand").alias("releaseGroup"),
            F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("name")))
            .alias("customFormats"), score.alias("customFormatScore"),
            (size > 30).alias("qualityCutoffNotMet"),
            F.struct(
                F.struct(F.col("p_type").alias("name"), F.lit("bluray").alias("source"),
                         (size * 40).alias("resolution"),
                         F.when(size > 20, "remux").alias("modifier")).alias("quality"),
                F.struct(F.lit(1).alias("version"), repack.alias("isRepack")).alias("revision"),
            ).alias("quality"))

    embedded = F.when(size >= 8, detail(F.lit(None).cast("int"), F.lit(False), F.lit("")))
    movies = part.select(as_json(
        id=key, tmdbId=key, qualityProfileId=size % 7, monitored=F.when(size > 12, size > 25),
        status=F.lit("released"), sizeOnDisk=(size * 1000).cast("bigint"),
        rootFolderPath=F.concat(F.lit("/"), F.col("p_brand")), studio=F.lit(""),
        tags=F.array(size, size - 10, F.lit(3)),
        added=F.concat(F.lit("2020-01-02T03:04:"), F.lpad(size.cast("string"), 2, "0"),
                       F.lit("Z")),
        movieFileId=F.when(size >= 8, unknown_at(5, F.col("p_partkey"), key) if whole else key),
        movieFile=embedded,
    ).alias("payload"), F.col("p_partkey").alias("seq"))
    full = detail(size, size > 45, F.concat(F.lit(" "), F.upper("p_type")))
    files = part.filter("true" if whole else "p_retailprice >= 905.5").select(
        F.to_json(full).alias("payload"), F.col("p_partkey").alias("seq"))
    return {
        "movies": movies, "files": files,
        "tags": vocabulary(spark, sf, "nation", "n_nationkey", "n_name"),
        "profiles": vocabulary(spark, sf, "region", "r_regionkey", "r_name"),
    }


HAS_FILE = f"({PRESENT} AND (p_size >= 8))"
DETAIL = "(p_retailprice >= 905.5)"
DETAIL_WHOLE = "(p_partkey % 5 <> 0)"
TAGS = """list_sort(list_filter([
    CASE WHEN p_size BETWEEN 0 AND 24 THEN 'NATION_' || p_size END,
    CASE WHEN p_size - 10 BETWEEN 0 AND 24 THEN 'NATION_' || (p_size - 10) END, 'NATION_3'],
    lambda x: x IS NOT NULL))"""


@query("movie_facts", f"""
    SELECT p_partkey AS item_id, {PRESENT} AS managed,
        CASE WHEN {PRESENT} THEN r_name END AS quality_profile,
        CASE WHEN {PRESENT} THEN p_size > 25 END AS monitored,
        CASE WHEN {PRESENT} THEN CAST(p_size * 1000 AS DOUBLE) END AS size_on_disk,
        CASE WHEN {PRESENT} THEN '/' || p_brand END AS root_folder,
        CAST(NULL AS VARCHAR) AS studio,
        CASE WHEN {PRESENT} THEN array_to_string({TAGS}, ',') END AS tags,
        CASE WHEN {PRESENT} THEN CAST(1577934240 + p_size AS BIGINT) END AS added,
        CASE WHEN {HAS_FILE} THEN p_type END AS quality,
        CASE WHEN {HAS_FILE} THEN p_size > 20 END AS remux,
        CASE WHEN {HAS_FILE} THEN {DETAIL} AND p_size > 45 END AS proper_repack,
        CASE WHEN {HAS_FILE} THEN array_to_string(list_sort(string_split(p_name, ' ')), ',') END
            AS custom_formats,
        CASE WHEN {HAS_FILE} THEN CAST(CASE WHEN {DETAIL} THEN p_size ELSE 0 END AS DOUBLE) END
            AS custom_format_score,
        CASE WHEN {HAS_FILE} THEN p_size > 30 END AS cutoff_unmet,
        CASE WHEN {HAS_FILE} THEN CASE WHEN {DETAIL} THEN lower(p_type) ELSE '' END END AS edition
    FROM part LEFT JOIN region ON r_regionkey = p_size % 7""")
def movie_facts(spark, sf, whole=False):
    done = MovieMgmt().compute(part_items(spark, sf, whole), movie_sources(spark, sf, whole))
    names = ["managed", "quality_profile", "monitored", "size_on_disk", "root_folder", "studio",
             "added", "quality", "remux", "proper_repack", "custom_format_score", "cutoff_unmet",
             "edition"]
    return done.select(
        "item_id", *[f"radarr.{n}" for n in names], listed("radarr.tags").alias("tags"),
        listed("radarr.custom_formats").alias("custom_formats"))


@query("movie_facts_whole", ORACLES["movie_facts"].replace(PRESENT, PRESENT_WHOLE)
       .replace(DETAIL, DETAIL_WHOLE))
def movie_facts_whole(spark, sf):
    return movie_facts(spark, sf, whole=True)


@query("payload_left_join", f"SELECT p_partkey AS item_id, {PRESENT} AS managed FROM part")
def payload_left_join(spark, sf, whole=False):
    done = MovieMgmt().compute(part_items(spark, sf, whole), movie_sources(spark, sf, whole))
    return done.select("item_id", "radarr.managed")


@query("payload_left_join_whole", ORACLES["payload_left_join"].replace(PRESENT, PRESENT_WHOLE))
def payload_left_join_whole(spark, sf):
    return payload_left_join(spark, sf, whole=True)


@query("tags_resolved", f"""
    SELECT p_partkey AS item_id, array_to_string({TAGS}, ',') AS tags FROM part""")
def tags_resolved(spark, sf):
    size = F.col("p_size")
    rows = t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.array(size, size - 10, F.lit(3)).alias("ids"))
    named = resolve_names(rows, "item_id", "ids", "tags",
                          vocabulary(spark, sf, "nation", "n_nationkey", "n_name"))
    return named.select("item_id", listed("tags").alias("tags"))


@query("tags_resolved_large", """
    SELECT o_orderkey AS item_id, array_to_string(list_sort(list_filter(
        [a.c_name, b.c_name], lambda x: x IS NOT NULL)), ',') AS tags
    FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey
    LEFT JOIN customer b ON b.c_custkey = o_orderkey""")
def tags_resolved_large(spark, sf):
    """A vocabulary that grows with the data; beyond the size for a map it is joined."""
    rows = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.array("o_custkey", "o_orderkey").alias("ids"))
    named = resolve_names(rows, "item_id", "ids", "tags",
                          vocabulary(spark, sf, "customer", "c_custkey", "c_name"))
    return named.select("item_id", listed("tags").alias("tags"))


# ── series automation: customers ──────────────────────────────────────────────


def series_sources(spark, sf, whole=False):
    key, nation = F.col("c_custkey") + 1, F.col("c_nationkey")
    series = t.table(spark, sf, "customer").filter(
            "true" if whole else "c_mktsegment <> 'MACHINERY'").select(
        as_json(
            id=key, tvdbId=key, qualityProfileId=nation % 6, monitored=nation > 3,
            status=F.lit("ended"), ended=F.when(nation > 5, F.lit(True)),
            seriesType=F.lit("anime"), network=F.col("c_mktsegment"), runtime=nation,
            genres=F.array("c_mktsegment", F.lit("Drama")), tags=F.array(nation, F.lit(99)),
            ratings=F.struct((nation / 8).alias("value")),
            firstAired=F.concat(F.lit("1999-01-"), F.lpad((nation + 1).cast("string"), 2, "0")),
            statistics=F.struct(
                nation.alias("seasonCount"), (nation % 5).alias("episodeCount"),
                (nation % 3).alias("episodeFileCount"),
                F.array(F.lit("z"), F.col("c_mktsegment")).alias("releaseGroups"),
                (nation / 3).alias("percentOfEpisodes")),
        ).alias("payload"), F.col("c_custkey").alias("seq"))
    return {"series": series, "tags": vocabulary(spark, sf, "nation", "n_nationkey", "n_name"),
            "profiles": vocabulary(spark, sf, "region", "r_regionkey", "r_name")}


KNOWN = "(c_mktsegment <> 'MACHINERY')"


@query("series_facts", f"""
    SELECT c_custkey AS item_id, {KNOWN} AS managed,
        CASE WHEN {KNOWN} THEN r_name END AS quality_profile,
        CASE WHEN {KNOWN} THEN c_nationkey > 5 END AS ended,
        CASE WHEN {KNOWN} AND c_nationkey <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS runtime,
        CASE WHEN {KNOWN} THEN c_mktsegment || ',Drama' END AS genres,
        CASE WHEN {KNOWN} THEN 'NATION_' || c_nationkey END AS tags,
        CASE WHEN {KNOWN} THEN c_mktsegment || ',z' END AS release_groups,
        CASE WHEN {KNOWN} THEN round(c_nationkey / 8, 2) END AS rating,
        CASE WHEN {KNOWN} THEN CAST(epoch(make_date(1999, 1, c_nationkey + 1)) AS BIGINT) END
            AS first_aired,
        CASE WHEN {KNOWN} THEN CAST(0 AS DOUBLE) END AS size_on_disk,
        CASE WHEN {KNOWN} THEN round(c_nationkey / 3, 1) END AS percent_of_episodes,
        CASE WHEN {KNOWN} THEN c_nationkey % 5 > 0 AND c_nationkey % 3 < c_nationkey % 5 END
            AS incomplete,
        CASE WHEN {KNOWN} THEN CAST(greatest(0, c_nationkey % 5 - c_nationkey % 3) AS DOUBLE) END
            AS missing_episodes
    FROM customer LEFT JOIN region ON r_regionkey = c_nationkey % 6""")
def series_facts(spark, sf, whole=False):
    key = F.col("c_custkey") + 1
    items = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("item_id"),
        (unknown_at(7, F.col("c_custkey"), key) if whole else key).alias("tvdb_id"))
    done = SeriesMgmt().compute(items, series_sources(spark, sf, whole))
    names = ["managed", "quality_profile", "ended", "runtime", "rating", "first_aired",
             "size_on_disk", "percent_of_episodes", "incomplete", "missing_episodes"]
    return done.select("item_id", *[f"sonarr.{n}" for n in names], *[
        listed(f"sonarr.{n}").alias(n) for n in ("genres", "tags", "release_groups")])


@query("series_facts_whole", ORACLES["series_facts"].replace(KNOWN, "(c_custkey % 7 <> 0)"))
def series_facts_whole(spark, sf):
    return series_facts(spark, sf, whole=True)


# ── media probe: parts as files with a few streams ────────────────────────────


def probe_payloads(spark, sf):
    size = F.col("p_size")
    text, number, tags = "string", "int", "map<string,string>"

    def stream(kind, **fields):
        kinds = {"codec_name": text, "width": number, "height": number, "color_transfer": text,
                 "avg_frame_rate": text, "r_frame_rate": text, "field_order": text,
                 "channels": number, "tags": tags, "disposition": "map<string,int>",
                 "side_data_list": "array<struct<side_data_type:string,dv_profile:int>>"}
        return F.struct(F.lit(kind).alias("codec_type"), *[
            fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])

    dolby = F.array(F.struct(F.lit("DOVI configuration record").alias("side_data_type"),
                             F.when(size > 45, 8).alias("dv_profile")))
    streams = F.array(
        stream("audio", codec_name=F.lit("ac3"), channels=size % 9,
               tags=F.create_map(F.lit("language"), F.lower("p_type")),
               disposition=F.create_map(F.lit("comment"), (size > 30).cast("int"))),
        F.when(size != 4, stream(
            "video", codec_name=F.lower("p_brand"), width=size * 80, height=F.lit(1000),
            color_transfer=F.when(size % 2 == 0, "smpte2084"),
            avg_frame_rate=F.concat((size * 1000).cast("string"), F.lit("/1001")),
            field_order=F.when(size > 20, F.when(size > 30, "tt").otherwise("progressive")),
            side_data_list=F.when(size > 40, dolby))),
        F.when(size > 15, stream(
            "audio", codec_name=F.lit("dts"), channels=F.lit(6),
            disposition=F.create_map(F.lit("default"), F.lit(1)))),
        stream("subtitle", disposition=F.create_map(F.lit("forced"), size % 2)))
    return t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), as_json(
            format=F.struct((size * 60).cast("string").alias("duration"),
                            F.when(size > 2, "12345").otherwise("N/A").alias("size"),
                            (size * 1000).cast("string").alias("bit_rate"),
                            F.lit("mkv").alias("format_name")),
            streams=F.array_compact(streams)).alias("payload"))


def _bucket_sql(ratio):
    tests = " ".join(f"WHEN abs({ratio} - {v}) / {v} <= {TOLERANCE} THEN '{label}'"
                     for v, label in RATIOS)
    return f"CASE {tests} ELSE 'other' END"


@query("probe_facts", f"""
    SELECT p_partkey AS item_id, CASE WHEN p_size = 4 THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN p_size <> 4 THEN round(p_size * 80 / 1000, 4) END AS dar,
        CASE WHEN p_size <> 4 THEN {_bucket_sql('(p_size * 80 / 1000)')} END AS aspect_bucket,
        CASE WHEN p_size <> 4 THEN lower(p_brand) END AS video_codec,
        CASE WHEN p_size <> 4 THEN CASE WHEN p_size > 45 THEN 'dv_p8' WHEN p_size > 40 THEN 'dv'
            WHEN p_size % 2 = 0 THEN 'hdr10' ELSE 'sdr' END END AS hdr_format,
        CASE WHEN p_size <> 4 THEN round(p_size * 1000 / 1001, 3) END AS fps,
        CASE WHEN p_size <> 4 THEN p_size > 30 END AS interlaced,
        CASE WHEN p_size <> 4 THEN CASE WHEN p_size > 15 THEN 'dts' ELSE 'ac3' END END
            AS audio_codec,
        CASE WHEN p_size <> 4 THEN CASE
            WHEN p_size > 15 THEN '5.1' WHEN p_size % 9 = 1 THEN 'mono'
            WHEN p_size % 9 = 2 THEN 'stereo' WHEN p_size % 9 = 6 THEN '5.1'
            WHEN p_size % 9 = 8 THEN '7.1' WHEN p_size % 9 = 0 THEN 'unknown'
            ELSE (p_size % 9) || 'ch' END END AS layout,
        CASE WHEN p_size <> 4 THEN CASE WHEN p_size > 15 THEN CASE WHEN lower(p_type) < 'und'
            THEN lower(p_type) || ',und' ELSE 'und,' || lower(p_type) END
            ELSE lower(p_type) END END AS languages,
        CASE WHEN p_size <> 4 THEN p_size > 30 END AS has_commentary,
        CASE WHEN p_size <> 4 THEN CAST(CASE WHEN p_size > 15 THEN 2 ELSE 1 END AS DOUBLE) END
            AS audio_tracks,
        CASE WHEN p_size <> 4 THEN p_size % 2 = 1 END AS has_forced,
        CASE WHEN p_size <> 4 THEN CAST(p_size * 60 AS DOUBLE) END AS duration_s,
        CASE WHEN p_size <> 4 AND p_size > 2 THEN CAST(12345 AS DOUBLE) END AS size_bytes,
        CASE WHEN p_size <> 4 THEN CAST(p_size AS DOUBLE) END AS bitrate_kbps
    FROM part""")
def probe_facts(spark, sf):
    items = t.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"))
    done = Probe().compute(items, {"probe": probe_payloads(spark, sf)})
    return done.select(
        "item_id", "status", "video.dar", "video.aspect_bucket",
        F.col("video.codec").alias("video_codec"), "video.hdr_format", "video.fps",
        "video.interlaced", F.col("audio.codec").alias("audio_codec"), "audio.layout",
        listed("audio.languages").alias("languages"), "audio.has_commentary",
        F.col("audio.track_count").alias("audio_tracks"), "subs.has_forced", "file.duration_s",
        "file.size_bytes", "file.bitrate_kbps")


# ── derived facts: lines as files ─────────────────────────────────────────────

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
KEYS = ", ".join(LINE)


def derived_query(name, value, sql):
    """``value`` makes the Column from quantity, extended price and line number."""
    @query(f"derived_{name}", f"SELECT {KEYS}, {sql} AS {name} FROM lineitem")
    def run(spark, sf):
        made = value(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_linenumber"))
        return t.table(spark, sf, "lineitem").select(*LINE, made.alias(name))


derived_query("resolution_class", lambda q, price, n: derived.resolution_class(
    F.when(n != 3, q * 80 - 400)), """
    CASE WHEN l_linenumber = 3 OR l_quantity = 5 THEN NULL
         WHEN l_quantity * 80 - 400 >= 3000 THEN '4k' WHEN l_quantity * 80 - 400 >= 1800
         THEN '1080p' WHEN l_quantity * 80 - 400 >= 1200 THEN '720p'
         WHEN l_quantity * 80 - 400 > 0 THEN 'sd' ELSE 'other' END""")
derived_query("is_scope", lambda q, price, n: derived.is_scope(q / 10), "l_quantity / 10 >= 2.3")
derived_query("bitrate_per_pixel", lambda q, price, n: derived.bitrate_per_pixel(
    q - 1, q * 16, n * 9), """
    CASE WHEN l_quantity <> 1
         THEN round((l_quantity - 1) * 1000 / (l_quantity * 16 * l_linenumber * 9), 6) END""")
derived_query("size_per_minute_mb", lambda q, price, n: derived.size_per_minute(
    q * 1_000_000, (n - 1) * 60), """
    CASE WHEN l_linenumber > 1 THEN round(l_quantity / (l_linenumber - 1), 2) END""")
derived_query("runtime_mismatch_min", lambda q, price, n: derived.runtime_drift(
    (q - 1) * 60, n), """
    CASE WHEN l_quantity > 1 THEN round(l_quantity - 1 - l_linenumber, 2) END""")
derived_query("runtime_vs_tmdb_min", lambda q, price, n: derived.runtime_delta(
    F.when(n > 2, (q - 1) * 30), q + 1, n - 1), """
    CASE WHEN l_linenumber > 1 THEN round(CASE WHEN l_linenumber > 2 AND l_quantity > 1
         THEN (l_quantity - 1) / 2 ELSE l_quantity + 1 END - (l_linenumber - 1), 2) END""")
derived_query("is_foreign",
              lambda q, price, n: derived.is_foreign(F.when(n > 1, F.lower("l_returnflag"))),
              "CASE WHEN l_linenumber > 1 THEN true END")
derived_query("is_box_office_bomb",
              lambda q, price, n: derived.is_bomb((n - 2) * 10000.0, price),
              "CASE WHEN l_linenumber > 2 THEN l_extendedprice < (l_linenumber - 2) * 10000.0 END")


@query("derived_all", f"""
    SELECT {KEYS}, CASE WHEN l_linenumber = 1 THEN 'skipped' ELSE 'ok' END AS status,
        CASE WHEN l_linenumber = 1 THEN 'no inputs computed yet' END AS reason,
        CASE WHEN l_linenumber > 1 THEN l_quantity / 10 >= 2.3 END AS is_scope,
        CASE WHEN l_linenumber > 1 THEN l_quantity - l_linenumber >= 5 END AS is_extended_cut,
        sha1(concat_ws('|', CASE WHEN l_linenumber > 1 THEN CAST(l_quantity / 10 AS VARCHAR)
            ELSE 'None' END, 'None', 'None', 'None',
            CASE WHEN l_linenumber > 1 THEN CAST(l_quantity * 60 AS VARCHAR) ELSE 'None' END,
            'None', 'None', CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS VARCHAR)
            ELSE 'None' END, 'None', 'None', 'None')) AS input_fp
    FROM lineitem""")
def derived_all(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    unknown, some = F.lit(None).cast("double"), n > 1
    items = t.table(spark, sf, "lineitem").select(
        F.struct(*LINE).alias("item_id"),
        F.struct(F.when(some, q / 10).alias("dar"), unknown.alias("width"),
                 unknown.alias("height")).alias("video"),
        F.struct(unknown.alias("bitrate_kbps"), F.when(some, q * 60).alias("duration_s"),
                 unknown.alias("size_bytes")).alias("file"),
        F.struct(unknown.alias("duration_min")).alias("plex"),
        F.struct(F.when(some, n).alias("runtime"), F.lit(None).cast("string")
                 .alias("original_language"), unknown.alias("budget"), unknown.alias("revenue"))
        .alias("tmdb"))
    items = items.withColumn("input_fp", Derived().fingerprint())
    return Derived().compute(items, {}).select(
        "item_id.*", "status", "reason", "derived.is_scope", "derived.is_extended_cut", "input_fp")


@query("ratio_bucket", f"""
    SELECT p_partkey AS item_id, {_bucket_sql('(p_size / 18)')} AS bucket FROM part""")
def ratio_buckets(spark, sf):
    return t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), ratio_bucket(F.col("p_size") / 18).alias("bucket"))


@query("ratio_parse", """
    SELECT p_partkey AS item_id,
           CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE round(p_size / (p_size % 5), 4) END AS ratio,
           CASE WHEN p_size % 5 = 0 THEN NULL ELSE round(p_size / (p_size % 5), 3) END AS fps
    FROM part""")
def ratio_parse(spark, sf):
    size = F.col("p_size")

    def written(sep):
        return F.concat(size.cast("string"), F.lit(sep), (size % 5).cast("string"))

    return t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.round(ratio_of(written(":"), 1.0), 4).alias("ratio"), rate_of(written("/")).alias("fps"))
