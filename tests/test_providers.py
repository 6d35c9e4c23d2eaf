"""Payloads with known facts."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators.providers import (
    Derived, Film, History, Identity, MovieMgmt, Probe, Rollup, SeriesMgmt,
)
from factloom.operators.providers.probe import rate_of, ratio_bucket, ratio_of

PROFILES = [(31, "Archive"), (12, "Daily 720"), (13, "")]
TAGS = [(41, "loan"), (43, "festival"), (47, "attic")]


def named(spark, rows):
    return spark.createDataFrame(rows, "id bigint, name string")


def payloads(spark, *docs):
    return spark.createDataFrame(
        [(json.dumps(d), i) for i, d in enumerate(docs)], "payload string, seq bigint")


def items(spark, **columns):
    names, rows = list(columns), list(zip(*columns.values()))
    kinds = {"tmdb_id": "bigint", "tvdb_id": "bigint", "leaf_count": "int",
             "viewed_leaf_count": "int"}
    return spark.createDataFrame(
        rows, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def facts_of(row, *spaces):
    """Emitted facts as a flat dict."""
    return {f"{s}.{k}": v for s in spaces if row[s] is not None
            for k, v in row[s].asDict().items() if v is not None}


FILM = {
    "title": "The Harbour Ledger", "runtime": 97, "budget": 8_000_000,
    "revenue": 14_600_000, "vote_average": 6.346, "vote_count": 842,
    "original_language": "da", "release_date": "2009-03-14", "adult": False,
    "tagline": "Every pier keeps count.",
    "belongs_to_collection": {"id": 9051, "name": "Ledger Cycle"},
    "genres": [{"name": "Mystery"}, {"name": "Family"}],
    "production_countries": [{"iso_3166_1": "DK"}, {"iso_3166_1": "IS"}],
    "keywords": {"keywords": [{"name": "Tides"}, {"name": "Accounting"}, {"name": "tides"}]},
}


def test_film(spark):
    rows = spark.createDataFrame(
        [(1, json.dumps(FILM)), (2, json.dumps({"title": "x", "budget": 0, "revenue": 0})),
         (3, "{}")], "tmdb_id bigint, payload string")
    got = {r.item_id: r for r in Film().compute(
        items(spark, item_id=["a", "b", "c", "d"], tmdb_id=[1, 2, 3, 4]),
        {"films": rows}).collect()}
    full = facts_of(got["a"], "tmdb")
    assert full == {
        "tmdb.keywords": ["accounting", "tides"], "tmdb.collection": "Ledger Cycle",
        "tmdb.runtime": 97.0, "tmdb.budget": 8e6, "tmdb.revenue": 1.46e7,
        "tmdb.roi": 1.825, "tmdb.vote_average": 6.35, "tmdb.vote_count": 842.0,
        "tmdb.original_language": "da", "tmdb.genres": ["Mystery", "Family"],
        "tmdb.countries": ["DK", "IS"], "tmdb.release_date": 1236988800, "tmdb.adult": False,
        "tmdb.tagline": "Every pier keeps count."}
    sparse = facts_of(got["b"], "tmdb")
    assert sparse["tmdb.keywords"] == [] and "tmdb.roi" not in sparse
    assert "tmdb.collection" not in sparse and sparse["tmdb.budget"] == 0
    assert got["c"].status == got["d"].status == "error" and got["d"].reason
    assert facts_of(got["d"], "tmdb") == {}


MOVIE = {
    "id": 615, "tmdbId": 70707, "title": "The Harbour Ledger", "qualityProfileId": 31,
    "monitored": True, "status": "inCinemas", "sizeOnDisk": 5_250_000_000,
    "rootFolderPath": "/vault/films", "studio": "Kelp and Sons", "certification": "PG",
    "tags": [47, 2, 41], "added": "2019-11-05T06:07:08Z", "movieFileId": 77,
    "movieFile": {
        "id": 77, "edition": "", "releaseGroup": "OWL", "customFormats": [],
        "customFormatScore": None, "qualityCutoffNotMet": False,
        "quality": {"quality": {"name": "Remux-1080p", "source": "disc", "resolution": 1080,
                                "modifier": "remux"},
                    "revision": {"version": 1, "isRepack": False}}},
}
MOVIE_FILE = {
    "id": 77, "edition": " Long VERSION", "releaseGroup": "OWL",
    "customFormats": [{"name": "Mono"}, {"name": "Grain"}, {"name": "x265 encode"}],
    "customFormatScore": 260, "qualityCutoffNotMet": True,
    "quality": {"quality": {"name": "Remux-1080p", "source": "disc", "resolution": 1080,
                            "modifier": "remux"},
                "revision": {"version": 2, "isRepack": True}},
}


def test_names_of_an_id_that_repeats(spark):
    from factloom.functions import joins
    vocabulary = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, ""), (None, "d")], "id long, name string")
    rows = spark.createDataFrame([("x", [2, 1, 9], 1), ("y", [], None), ("z", None, 9)],
                                 "item_id string, ids array<long>, ref long")
    many = {r.item_id: r.names for r in joins.resolve_names(rows, "item_id", "ids", "names", vocabulary).collect()}
    assert many == {"x": ["a", "c"], "y": [], "z": []}
    one = {r.item_id: r.name for r in joins.resolve_name(rows, "item_id", "ref", "name", vocabulary).collect()}
    assert one == {"x": "a", "y": None, "z": None}


def test_movie_mgmt(spark):
    sources = {
        "movies": payloads(spark, {**MOVIE, "studio": "Old"}, MOVIE, {"id": 1, "tmdbId": 0},
                           {"id": 2, "tmdbId": 8, "movieFile": {}}),
        "files": payloads(spark, MOVIE_FILE),
        "profiles": named(spark, PROFILES), "tags": named(spark, TAGS)}
    frame = items(spark, item_id=["a", "b", "c"], tmdb_id=[70707, 7, 8])
    got = {r.item_id: facts_of(r, "radarr") for r in MovieMgmt().compute(frame, sources).collect()}
    assert got["a"] == {
        "radarr.managed": True, "radarr.quality_profile": "Archive",
        "radarr.quality": "Remux-1080p", "radarr.source": "disc", "radarr.resolution": 1080.0,
        "radarr.remux": True, "radarr.custom_formats": ["Grain", "Mono", "x265 encode"],
        "radarr.custom_format_score": 260.0, "radarr.cutoff_unmet": True,
        "radarr.release_group": "OWL", "radarr.edition": "long version",
        "radarr.proper_repack": True, "radarr.tags": ["attic", "loan"],
        "radarr.root_folder": "/vault/films", "radarr.monitored": True,
        "radarr.movie_status": "inCinemas", "radarr.size_on_disk": 5.25e9,
        "radarr.added": 1572934028, "radarr.studio": "Kelp and Sons",
        "radarr.certification": "PG"}
    assert got["b"] == {"radarr.managed": False}
    assert got["c"] == {"radarr.managed": True, "radarr.monitored": False, "radarr.tags": []}

    del sources["files"]
    [row] = MovieMgmt().compute(frame.filter("item_id = 'a'"), sources).collect()
    embedded = facts_of(row, "radarr")
    assert row.status == "ok" and embedded["radarr.custom_formats"] == []
    assert embedded["radarr.custom_format_score"] == 0 and not embedded["radarr.cutoff_unmet"]
    assert embedded["radarr.edition"] == "" and not embedded["radarr.proper_repack"]
    vocabulary = MovieMgmt().vocabulary(sources)
    assert {r.value for r in vocabulary["radarr.quality_profile"].collect()} == {
        "Archive", "Daily 720"}


SERIES = {
    "id": 58, "tvdbId": 412345, "title": "Tin Orchard", "qualityProfileId": 12, "monitored": True,
    "status": "ended", "ended": True, "seriesType": "daily", "network": "Canal Norte",
    "runtime": 42, "certification": "TV-PG", "rootFolderPath": "/vault/series",
    "genres": ["Satire", "Drama"], "tags": [43], "ratings": {"value": 7.1},
    "originalLanguage": {"name": "Portuguese"}, "added": "2020-05-06T07:08:09Z",
    "firstAired": "2015-02-03T00:00:00Z", "lastAired": "2018-09-10T00:00:00Z",
    "statistics": {"seasonCount": 3, "episodeCount": 40, "episodeFileCount": 31,
                   "sizeOnDisk": 12_500_000_000, "releaseGroups": ["ZED", "Arc"],
                   "percentOfEpisodes": 77.5},
}
UNAIRED = {
    "id": 59, "tvdbId": 555111, "qualityProfileId": 12, "monitored": True, "status": "upcoming",
    "ended": False, "seriesType": "standard",
    "statistics": {"seasonCount": 1, "episodeCount": 0, "episodeFileCount": 0, "sizeOnDisk": 0,
                   "releaseGroups": [], "percentOfEpisodes": 0},
}


def test_series_mgmt(spark):
    sources = {"series": payloads(spark, SERIES, UNAIRED), "profiles": named(spark, PROFILES),
               "tags": named(spark, TAGS)}
    frame = items(spark, item_id=["a", "b", "c"], tvdb_id=[412345, 555111, 1])
    got = {r.item_id: facts_of(r, "sonarr")
           for r in SeriesMgmt().compute(frame, sources).collect()}
    assert got["a"] == {
        "sonarr.managed": True, "sonarr.percent_of_episodes": 77.5, "sonarr.incomplete": True,
        "sonarr.missing_episodes": 9.0, "sonarr.series_type": "daily",
        "sonarr.series_status": "ended", "sonarr.ended": True, "sonarr.network": "Canal Norte",
        "sonarr.quality_profile": "Daily 720", "sonarr.monitored": True, "sonarr.tags": ["festival"],
        "sonarr.season_count": 3.0, "sonarr.episode_count": 40.0,
        "sonarr.episode_file_count": 31.0, "sonarr.size_on_disk": 1.25e10,
        "sonarr.release_groups": ["Arc", "ZED"], "sonarr.root_folder": "/vault/series",
        "sonarr.genres": ["Satire", "Drama"], "sonarr.rating": 7.1,
        "sonarr.certification": "TV-PG", "sonarr.runtime": 42.0,
        "sonarr.original_language": "Portuguese", "sonarr.added": 1588748889,
        "sonarr.first_aired": 1422921600, "sonarr.last_aired": 1536537600}
    assert got["b"]["sonarr.incomplete"] is False and got["b"]["sonarr.missing_episodes"] == 0
    assert got["c"] == {"sonarr.managed": False}


def test_match_ids_are_required(spark):
    from factloom.plans.staleness import split_eligible
    frame = items(spark, item_id=["a", "b"], tmdb_id=[None, 5], tvdb_id=[0, 5]).withColumn(
        "input_fp", F.lit(None).cast("string"))
    for provider in (MovieMgmt(), SeriesMgmt(), Film()):
        good, bad = split_eligible(frame, provider)
        assert [r.item_id for r in good.collect()] == ["b"]
        [skip] = bad.collect()
        assert skip.status == "skipped" and skip.reason


def test_history(spark):
    rows = [("k7", 1234500000, None, "ines", 1.0), ("k7", 0, 1345600000, "otto", 1.0),
            ("k7", 1111100000, None, "ines", 0.5), ("k8", 1234500000, None, "ines", 0.0),
            ("k8", 1234500009, None, "", None), (None, 1, 1, "x", 1.0), ("", 1, 1, "x", 1.0)]
    history = spark.createDataFrame(
        rows, "rating_key string, date bigint, stopped bigint, user string, watched_status double")
    frame = items(spark, item_id=["a", "b", "c", "d"], rating_key=["k7", "k8", "k9", None])
    got = {r.item_id: facts_of(r, "watch")
           for r in History().compute(frame, {"history": history}).collect()}
    assert got["a"] == {"watch.play_count": 3.0, "watch.last_played": 1345600000,
                        "watch.never_played": False, "watch.unique_users": 2.0,
                        "watch.completed_count": 2.0, "watch.abandoned": False}
    assert got["b"]["watch.abandoned"] is True and got["b"]["watch.unique_users"] == 1
    never = {"watch.play_count": 0.0, "watch.never_played": True, "watch.unique_users": 0.0,
             "watch.completed_count": 0.0, "watch.abandoned": False}
    assert got["c"] == got["d"] == never


DERIVED_SCHEMA = (
    "item_id string, video struct<width:double,height:double,dar:double>, "
    "file struct<duration_s:double,bitrate_kbps:double,size_bytes:double>, "
    "plex struct<duration_min:double>, "
    "tmdb struct<runtime:double,original_language:string,budget:double,revenue:double>")


def test_derived(spark):
    rows = [
        ("cut", (3840.0, 1600.0, 2.4), (175 * 60.0, 20000.0, 4.2e10), (170.0,),
         (164.0, "en", None, None)),
        ("near", (1920.0, 800.0, 2.39), (164 * 60 + 30.0, None, None), None,
         (164.0, None, None, None)),
        ("foreign", (1920.0, 1080.0, 1.78), None, None, (None, "ja", 0.0, 0.0)),
        ("bomb", (640.0, 480.0, 1.33), None, (100.0,), (90.0, "", 2e8, 9e7)),
        ("none", (0.0, 0.0, None), (0.0, None, None), None, None),
    ]
    frame = spark.createDataFrame(rows, DERIVED_SCHEMA)
    frame = frame.withColumn("input_fp", Derived().fingerprint())
    got = {r.item_id: r for r in Derived().compute(frame, {}).collect()}
    assert facts_of(got["cut"], "derived") == {
        "derived.resolution_class": "4k", "derived.is_scope": True,
        "derived.bitrate_per_pixel": round(20000 * 1000 / (3840 * 1600), 6),
        "derived.size_per_minute_mb": 240.0, "derived.runtime_mismatch_min": 5.0,
        "derived.runtime_vs_tmdb_min": 11.0, "derived.is_extended_cut": True,
        "derived.is_foreign": False}
    near = facts_of(got["near"], "derived")
    assert near["derived.is_extended_cut"] is False and near["derived.is_scope"] is True
    assert near["derived.resolution_class"] == "1080p"
    foreign = facts_of(got["foreign"], "derived")
    assert foreign["derived.is_foreign"] is True
    assert "derived.is_box_office_bomb" not in foreign
    bomb = facts_of(got["bomb"], "derived")
    assert bomb == {"derived.resolution_class": "sd", "derived.is_scope": False,
                    "derived.runtime_vs_tmdb_min": 10.0, "derived.is_extended_cut": True,
                    "derived.is_box_office_bomb": True}
    assert got["none"].status == "skipped" and got["none"].reason == "no inputs computed yet"
    assert len({r.input_fp for r in got.values()}) == 5


def test_identity(spark):
    frame = spark.createDataFrame(
        [("a", "Salt Road", 1987, 1333000000, 0, 6_420_000, 5), ("b", "X", None, None, None, 0, None)],
        "item_id string, title string, year int, added_at bigint, updated_at bigint, "
        "duration_ms bigint, tmdb_id bigint")
    got = {r.item_id: facts_of(r, "plex") for r in Identity().compute(frame, {}).collect()}
    assert got["a"] == {"plex.title": "Salt Road", "plex.year": 1987.0, "plex.added_at": 1333000000,
                        "plex.duration_min": 107.0, "plex.has_tmdb_id": True}
    assert got["b"] == {"plex.title": "X", "plex.has_tmdb_id": False}
    assert frame.select(Identity().fingerprint()).collect()[0][0] == "0|Salt Road|1987|6420000"


PROBE = {
    "format": {"duration": "7200.456", "size": "42000000000", "bit_rate": "46666666",
               "format_name": "matroska,webm"},
    "streams": [
        {"codec_type": "audio", "codec_name": "ac3", "channels": 6,
         "tags": {"language": "fra", "TITLE": "Director's Commentary"},
         "disposition": {"default": 0, "comment": 0}},
        {"codec_type": "video", "codec_name": "hevc", "width": 3840, "height": 1600,
         "sample_aspect_ratio": "1:1", "display_aspect_ratio": "12:5",
         "color_transfer": "smpte2084", "field_order": "progressive",
         "bits_per_raw_sample": "10", "avg_frame_rate": "24000/1001", "r_frame_rate": "25/1",
         "side_data_list": [{"side_data_type": "other"},
                            {"side_data_type": "DOVI configuration record", "dv_profile": 8}]},
        {"codec_type": "audio", "codec_name": "truehd", "channels": 8,
         "disposition": {"default": 1}},
        {"codec_type": "subtitle", "tags": {"language": "eng"}, "disposition": {"forced": 1}},
        {"codec_type": "subtitle", "tags": {"language": "eng"}},
    ],
}
PLAIN = {
    "format": {"duration": "N/A"},
    "streams": [{"codec_type": "video", "codec_name": "mpeg2video", "width": 720, "height": 576,
                 "sample_aspect_ratio": "64:45", "display_aspect_ratio": "0:1",
                 "color_transfer": "arib-std-b67", "field_order": "tt",
                 "bits_per_coded_sample": "N/A", "avg_frame_rate": "0/0",
                 "r_frame_rate": "25/1"}],
}


def test_probe(spark):
    rows = [("a", json.dumps(PROBE)), ("b", json.dumps(PLAIN)),
            ("c", json.dumps({"streams": [{"codec_type": "audio"}]})), ("d", "oops")]
    frame = items(spark, item_id=list("abcde"), file_fp=["fp"] * 5).withColumn(
        "input_fp", F.col("file_fp"))
    got = {r.item_id: r for r in Probe().compute(frame, {
        "probe": spark.createDataFrame(rows, "item_id string, payload string")}).collect()}
    spaces = ("video", "audio", "subs", "file")
    assert facts_of(got["a"], *spaces) == {
        "video.dar": 2.4, "video.aspect_bucket": "2.39:1", "video.width": 3840.0,
        "video.height": 1600.0, "video.sar": 1.0, "video.codec": "hevc",
        "video.hdr_format": "dv_p8", "video.bit_depth": 10.0, "video.fps": 23.976,
        "video.interlaced": False, "audio.codec": "truehd", "audio.channels": 8.0,
        "audio.layout": "7.1", "audio.track_count": 2.0, "audio.languages": ["fra", "und"],
        "audio.has_commentary": True, "subs.track_count": 2.0, "subs.languages": ["eng"],
        "subs.has_forced": True, "file.duration_s": 7200.46, "file.size_bytes": 4.2e10,
        "file.bitrate_kbps": 46666.7, "file.container": "matroska,webm"}
    assert facts_of(got["b"], *spaces) == {
        "video.dar": 1.7778, "video.aspect_bucket": "1.78:1", "video.width": 720.0,
        "video.height": 576.0, "video.sar": 1.4222, "video.codec": "mpeg2video",
        "video.hdr_format": "hlg", "video.fps": 25.0, "video.interlaced": True,
        "audio.track_count": 0.0, "audio.languages": [], "subs.track_count": 0.0,
        "subs.languages": [], "subs.has_forced": False}
    assert {k: (got[k].status, got[k].reason) for k in "cde"} == {
        "c": ("error", "no video stream found"), "d": ("error", "unparseable probe output"),
        "e": ("error", "no probe output")}
    assert got["a"].input_fp == "fp"


def test_ratio_functions(spark):
    rows = [("4:3", "24000/1001"), ("0:0", "0/0"), ("N/A", "x/1"), ("16:0", "-25/1"),
            (None, None), ("a:b", "30")]
    got = spark.createDataFrame(rows, "r string, f string").select(
        F.round(ratio_of(F.col("r"), 1.0), 4), rate_of(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(1.3333, 23.976)] + [(1.0, None)] * 5
    buckets = spark.createDataFrame([(x,) for x in (1.34, 1.36, 2.4, 2.36, 3.0, None)],
                                    "x double").select(ratio_bucket(F.col("x"))).collect()
    assert [r[0] for r in buckets] == ["1.33:1", "1.37:1", "2.39:1", "2.35:1", "other", None]


def test_rollup(spark):
    child = ("item_id string, parent_key string, item_type string, deleted_at bigint, "
             "file_size bigint, file struct<duration_s:double,bitrate_kbps:double>, "
             "derived struct<resolution_class:string>, "
             "video struct<hdr_format:string,aspect_bucket:string>, "
             "audio struct<languages:array<string>>")
    episodes = spark.createDataFrame([
        ("1", "s1", "episode", None, 2_000_000_000, (3000.0, 4000.0), ("4k",),
         ("dv_p5", "1.78:1"), (["eng", "jpn"],)),
        ("2", "s1", "episode", None, None, (1500.0, 2000.0), ("720p",), ("sdr", "1.78:1"),
         (["eng", "", None],)),
        ("3", "s1", "episode", 5, 9, (9.0, 9.0), ("sd",), ("hlg", "2.00:1"), (["deu"],)),
        ("4", "s2", "episode", None, None, None, None, None, None),
        ("5", None, "episode", None, 1, None, None, None, None),
    ], child)
    shows = items(spark, item_id=["a", "b", "c", "d"], rating_key=["s1", "s2", "s3", "s4"],
                  leaf_count=[10, None, 4, None], viewed_leaf_count=[1, None, 4, None])
    got = {r.item_id: r for r in Rollup().compute(shows, {"children": episodes}).collect()}
    assert facts_of(got["a"], "show") == {
        "show.episode_count": 2.0, "show.mixed_resolutions": True,
        "show.worst_resolution": "720p", "show.all_4k": False, "show.any_4k": True,
        "show.mixed_hdr": True, "show.any_dolby_vision": True,
        "show.hdr_formats": ["dv_p5", "sdr"], "show.total_size_bytes": 2e9,
        "show.size_per_episode_mb": 1000.0, "show.total_runtime_min": 75.0,
        "show.max_bitrate_kbps": 4000.0, "show.min_bitrate_kbps": 2000.0,
        "show.mean_bitrate_kbps": 3000.0, "show.audio_languages": ["eng", "jpn"],
        "show.aspect_buckets": ["1.78:1"], "show.leaf_count": 10.0, "show.watched_count": 1.0,
        "show.percent_watched": 10.0, "show.unwatched": False, "show.abandoned": True}
    assert facts_of(got["b"], "show") == {
        "show.episode_count": 1.0, "show.audio_languages": [], "show.aspect_buckets": []}
    assert facts_of(got["c"], "show") == {
        "show.leaf_count": 4.0, "show.watched_count": 4.0, "show.percent_watched": 100.0,
        "show.unwatched": False, "show.abandoned": False}
    assert got["d"].status == "skipped" and got["d"].reason == "no episodes indexed"


def test_kept_rollup_follows_its_children(spark, tmp_path):
    from factloom.operators.providers import rollup

    def episodes(*rows):
        return spark.createDataFrame(
            [(p, "episode", gone, size, (60.0, rate), (res,), (hdr, None), (langs,))
             for p, gone, size, rate, res, hdr, langs in rows],
            "parent_key string, item_type string, deleted_at bigint, file_size bigint, "
            "file struct<duration_s:double,bitrate_kbps:double>, "
            "derived struct<resolution_class:string>, "
            "video struct<hdr_format:string,aspect_bucket:string>, "
            "audio struct<languages:array<string>>")

    def same(items):
        return sorted(map(str, rollup.kept_totals(store).collect())) == sorted(
            map(str, rollup.children_by_parent(items).collect()))

    first = [("a", None, 5, 1.0, "4k", "sdr", ["en", ""]), ("a", None, None, 9.0, "sd", "dv", None),
             ("b", None, 3, None, None, "", []), ("c", None, 1, 2.0, "sd", None, ["fr"]),
             (None, None, 8, 8.0, "sd", "sdr", ["de"])]
    store = rollup.totals_store(spark, str(tmp_path / "totals"), 3)
    rollup.keep_up(store, episodes(*first), rollup.touched_parents(episodes(*first)), 1)
    assert same(episodes(*first))
    # the episode with a's extremes moves to d, c loses its only one, b stays as it is
    left, came = [first[1], first[3]], [("d",) + first[1][1:], ("c", 77) + first[3][2:]]
    second = [first[0], first[2], first[4], *came]
    for _ in range(2):  # a repeated update replaces itself
        touched = rollup.touched_parents(episodes(*left), episodes(*came))
        assert {r.parent_key for r in touched.collect()} == {"a", "c", "d"}
        rollup.keep_up(store, episodes(*second), touched, 2)
        assert same(episodes(*second))
    assert store.rows().count() == 6
    shows = spark.createDataFrame(
        [(1, "a", None, None), (2, "c", None, None)],
        "item_id int, rating_key string, leaf_count int, viewed_leaf_count int")
    rows = {r.item_id: r for r in Rollup().from_totals(shows, rollup.kept_totals(store)).collect()}
    assert rows[1].show.episode_count == 1 and rows[1].show.all_4k and rows[2].status == "skipped"
    rollup.keep_up(store, episodes(*second), touched.limit(0), 3)
    assert same(episodes(*second))


@pytest.mark.parametrize("few,bits", [(0, 63), (0, 1), (0, 0), (100_000, 1)])
def test_kept_rollup_with_many_parents_or_values(spark, tmp_path, monkeypatch, few, bits):
    from factloom.operators.providers import rollup
    monkeypatch.setattr(rollup, "FEW_PARENTS", few)
    monkeypatch.setattr(rollup, "BITS", bits)  # sets of more values are collected
    test_kept_rollup_follows_its_children(spark, tmp_path)


def test_kept_rollup_of_sets_beyond_the_bits(spark, tmp_path):
    from factloom.operators.providers import rollup
    rows = [(f"p{i % 3}", "episode", None, i, (1.0, 2.0), (["4k", None, ""][i % 3],),
             (f"h{i % 63:02}", f"a{i % 64:02}"), ([f"l{i}", "é", None],)) for i in range(192)]
    children = spark.createDataFrame(
        rows, "parent_key string, item_type string, deleted_at bigint, file_size bigint, "
        "file struct<duration_s:double,bitrate_kbps:double>, derived struct<resolution_class:string>, "
        "video struct<hdr_format:string,aspect_bucket:string>, audio struct<languages:array<string>>")
    assert set(rollup._coded(children)) == {"resolutions", "hdr"}
    store = rollup.totals_store(spark, str(tmp_path / "totals"), 2)
    rollup.keep_up(store, children, rollup.touched_parents(children), 1)
    kept = {r.parent_key: r.asDict() for r in rollup.kept_totals(store).collect()}
    assert kept == {r.parent_key: r.asDict() for r in rollup.children_by_parent(children).collect()}
    assert len(kept["p0"]["hdr"]) == 21 and len(kept["p0"]["languages"]) == 65


def test_kept_rollup_moves_sums_only(spark, tmp_path, monkeypatch):
    """Many touched parents: no child is shuffled, sorted or joined, and no set is collected."""
    from factloom.operators.providers import rollup
    from factloom.operators.store import Store
    children = spark.createDataFrame(
        [("a", "episode", None, 1, (1.0, 2.0), ("sd",), ("hdr", "x"), (["en"],))],
        "parent_key string, item_type string, deleted_at bigint, file_size bigint, "
        "file struct<duration_s:double,bitrate_kbps:double>, derived struct<resolution_class:string>, "
        "video struct<hdr_format:string,aspect_bucket:string>, audio struct<languages:array<string>>")
    store = rollup.totals_store(spark, str(tmp_path / "totals"), 2)
    plans = []
    monkeypatch.setattr(rollup, "FEW_PARENTS", 0, raising=False)
    monkeypatch.setattr(Store, "put", lambda _, rows, version: plans.append(
        rows._jdf.queryExecution().executedPlan().toString()))
    rollup.keep_up(store, children, rollup.touched_parents(children), 1)
    [plan] = plans
    plan = plan.split("InMemoryRelation")[0]
    assert "Join" not in plan and "collect_set" not in plan and "Sort" not in plan
    assert plan.count("Exchange") == 1 and "partial_bit_or" in plan
