"""Snapshots, reconcile, paths, fingerprints, fact and provenance merges, staleness."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import browse, facts, paths, reconcile, report
from factloom.operators.catalogue import CATALOGUE_SCHEMA, scope
from factloom.operators.providers import Derived, Film, History, Identity, Probe, default_providers
from factloom.plans import staleness
from factloom.sources import files, payloads, snapshot
from factloom.functions.spec import text, words

INCOMING = ("library_key string, rating_key string, guid string, item_type string, title string, "
            "sort_title string, year int, source_path string")


class Shelf:
    """A catalogue that takes snapshots of ``key -> (guid, file)``; files lie in ``folder``."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.runs = spark, str(folder), 0
        self.state = spark.createDataFrame([], CATALOGUE_SCHEMA)

    def put(self, name, size, at=1_500_000_000):
        path = os.path.join(self.folder, name)
        with open(path, "wb") as out:
            out.write(b"s" * size)
        os.utime(path, (at, at))

    def take(self, snapshot):
        self.runs += 1
        frame = self.spark.createDataFrame(
            [("9", key, guid, "movie", f"Title {guid}", guid, 1990, file) for key, (guid, file) in snapshot.items()],
            INCOMING)
        manifest = files.with_fingerprint(files.manifest(self.spark, self.folder))
        found = paths.resolve(frame, [("/srv/reels", self.folder)], manifest, item_id="rating_key")
        state, counts = reconcile.apply(self.state, found, ["9"], 50 * self.runs, self.runs)
        told = counts.first().asDict()
        self.state = self.spark.createDataFrame(state.collect(), state.schema)
        return {name: n for name, n in told.items() if n}

    def row(self, key):
        found = self.state.filter(F.col("rating_key") == key).collect()
        return found[0] if found else None


@pytest.fixture
def shelf(spark, tmp_path):
    made = Shelf(spark, tmp_path)
    made.put("pine.mp4", 300)
    made.put("oak.mp4", 500)
    return made


PINE, OAK, LOST = ("pine", "/srv/reels/pine.mp4"), ("oak", "/srv/reels/oak.mp4"), ("yew", "/srv/reels/yew.mp4")


def test_a_first_snapshot(shelf):
    told = shelf.take({"p": PINE, "o": OAK, "y": LOST, "n": ("net", "/mnt/other/net.mp4"), "u": ("none", None)})
    assert told["added"] == 5 and "removed" not in told
    assert {r.path_status: r.n for r in paths.health(shelf.state).collect()} == {
        "mapped": 2, "missing": 1, "unmapped": 1, "unknown": 1}
    assert shelf.row("p").file_size == 300 and shelf.row("p").first_seen == 50
    assert shelf.row("y").file_fp is None


def test_the_same_snapshot_again(shelf):
    shelf.take({"p": PINE, "o": OAK})
    assert shelf.take({"p": PINE, "o": OAK}) == {"seen": 2, "updated": 2}
    assert shelf.row("o").first_seen == 50


def test_what_vanishes_is_kept_and_may_return(shelf):
    shelf.take({"p": PINE, "o": OAK})
    assert shelf.take({"o": OAK})["removed"] == 1
    gone = shelf.row("p")
    assert gone.deleted_at == 100
    told = shelf.take({"o": OAK, "p": PINE})
    assert told["resurrected"] == 1 and "added" not in told
    assert shelf.row("p").deleted_at is None and shelf.row("p").item_id == gone.item_id


def test_a_new_key_for_a_known_guid_is_the_same_item(shelf):
    shelf.take({"p": PINE})
    before = shelf.row("p").item_id
    told = shelf.take({"p2": PINE})
    assert told["rotated"] == 1 and "added" not in told
    assert shelf.row("p") is None and shelf.row("p2").item_id == before
    # the old key is free again, for an item of its own
    assert shelf.take({"p2": PINE, "p": ("fresh", None)})["added"] == 1
    assert shelf.row("p").item_id != before


def test_a_changed_file_is_told(shelf):
    shelf.take({"p": PINE, "o": OAK})
    before = shelf.row("p").file_fp
    shelf.put("pine.mp4", 301, at=1_600_000_000)
    assert shelf.take({"p": PINE, "o": OAK})["changed_files"] == 1
    assert shelf.row("p").file_fp != before and shelf.row("p").file_size == 301


def test_shared_guids_and_unscanned_libraries(spark):
    schema = ("item_id string, library_key string, rating_key string, guid string, title string, "
              "file_fp string, first_seen bigint, last_seen bigint, seen_run bigint, "
              "deleted_at bigint")
    state = spark.createDataFrame([
        ("i1", "1", "k1", "g", "a", None, 0, 0, 0, None),
        ("i2", "1", "k2", "g", "b", None, 0, 0, 0, 7),
        ("i3", "2", "k3", "g", "c", None, 0, 0, 0, None),
        ("i4", "1", "k4", None, "d", None, 0, 0, 0, None),
    ], schema)
    snap = spark.createDataFrame(
        [("1", "n1", "g", "x", None), ("1", "n2", "g", "y", None), ("1", "n3", None, "z", None),
         ("3", "n4", "g", "other", None)],
        "library_key string, rating_key string, guid string, title string, file_fp string")
    result, counts = reconcile.apply(state, snap, ["1"], 50, 9)
    rows = {r.rating_key: r for r in result.collect()}
    assert rows["n2"].item_id == "i2" and rows["n2"].deleted_at is None
    assert rows["n1"].first_seen == 50 and rows["n3"].first_seen == 50 and "n4" not in rows
    assert rows["k1"].deleted_at == rows["k4"].deleted_at == 50
    assert rows["k3"].deleted_at is None and rows["k3"].seen_run == 0
    assert counts.first().asDict() == {
        "seen": 3, "added": 2, "updated": 0, "rotated": 1, "removed": 2, "resurrected": 1,
        "changed_files": 0}
    assert len({r.item_id for r in rows.values()}) == len(rows) == 6


MAPPINGS = [
    ("/data/movies", "/mnt/m"), ("/data/movies/4k/", "/mnt/uhd"), ("D:\\Films", "/mnt/win"),
    ("\\\\nas\\tv\\", "/mnt/tv"),
]
PATHS = {
    "/data/movies/a/b.mkv": "/mnt/m/a/b.mkv", "/data/movies": "/mnt/m",
    "/data/movies/": "/mnt/m", "/data/movies2/x": None, "/data/movies/4k/x.mkv": "/mnt/uhd/x.mkv",
    "/data/movies/4k": "/mnt/uhd", "/data/movies//c/./d.mkv": "/mnt/m/c/d.mkv",
    "d:\\films\\Sub\\X.mkv": "/mnt/win/Sub/X.mkv", "D:\\FilmsOther\\x": None,
    "\\\\NAS\\TV\\s1\\e1.mkv": "/mnt/tv/s1/e1.mkv", "": None, None: None,
}


@pytest.mark.parametrize("form", ["pairs", "frame"])
def test_translate(spark, form):
    frame = spark.createDataFrame(
        [(str(i), p) for i, p in enumerate(PATHS)], "item_id string, source_path string")
    mappings = MAPPINGS
    if form == "frame":
        mappings = spark.createDataFrame(MAPPINGS, "source string, local string")
    got = {r.source_path: r.local_path for r in paths.translate(frame, mappings).collect()}
    assert got == PATHS
    for none in ([], spark.createDataFrame([], "source string, local string")):
        assert paths.translate(frame, none).filter("local_path <=> source_path").count() == 11


def test_of_several_mappings_of_a_prefix_the_greatest_counts(spark):
    frame = spark.createDataFrame([("1", "/data/x")], "item_id string, source_path string")
    for pairs in ([("/data", "/aa"), ("/data", "/zz")], [("/data", "/zz"), ("/data", "/aa")]):
        assert paths.translate(frame, pairs).first().local_path == "/zz/x"


def test_path_status_without_mappings(spark):
    frame = spark.createDataFrame([("1", "/a/x"), ("2", "/a/y"), ("3", None)],
                                  "item_id string, source_path string")
    manifest = spark.createDataFrame([("/a/x", 5, 6)], "path string, size bigint, mtime bigint")
    empty = spark.createDataFrame([], "source string, local string")
    for mappings, absent in (([], "unmapped"), (empty, "unmapped"), ([("/a", "/a")], "missing")):
        got = {r.item_id: (r.path_status, r.file_size) for r in
               paths.resolve(frame, mappings, manifest).collect()}
        assert got == {"1": ("mapped", 5), "2": (absent, None), "3": ("unknown", None)}


@pytest.mark.parametrize("given,expected", [
    (["/srv/media/Videos/A/a.mkv", "/srv/media/Videos/B/b.mkv", "/srv/media/Videos/B/c.mkv"],
     {("/srv/media/Videos", 3)}),
    (["/a/x.mkv", "/b/y.mkv", "/b/z/w.mkv"], {("/a", 1), ("/b", 2)}),
    (["D:\\Films\\A\\a.mkv", "d:\\films\\B\\b.mkv", "/only/one.mkv"],
     {("D:\\Films", 2), ("/only", 1)}),
    (["/top.mkv", "/a/b.mkv"], {("/", 1), ("/a", 1)}),
    (["/one/two/three.mkv"], {("/one/two", 1)}),
])
def test_unmapped_prefixes(spark, given, expected):
    frame = spark.createDataFrame(
        [(p, "unmapped", None) for p in given] + [("/zzz/q", "mapped", None),
                                                  ("/yyy/q", "unmapped", 5)],
        "source_path string, path_status string, deleted_at bigint")
    rows = paths.unmapped_prefixes(frame).collect()
    assert {(r.prefix, r.n) for r in rows} == expected
    assert all(r.sample in given for r in rows)


def test_fingerprints(spark, tmp_path):
    big = b"a" * files.CHUNK + b"b" * files.CHUNK + b"c" * 10
    (tmp_path / "big.bin").write_bytes(big)
    (tmp_path / "small.bin").write_bytes(b"small")
    (tmp_path / "empty.bin").write_bytes(b"")
    assert files.manifest(spark, str(tmp_path), "*.bin").count() == 2
    paths_there = [(str(tmp_path / n),) for n in ("big.bin", "small.bin", "empty.bin", "no")]
    listed = files.stat(spark.createDataFrame(paths_there, "path string"))
    plain = {r.path: r for r in files.with_fingerprint(listed).collect()}
    deep = {r.path: r for r in files.with_fingerprint(listed, deep=True).collect()}
    assert len(plain) == 3
    for path, r in plain.items():
        meta = f"{path}|{os.path.getsize(path)}|{int(os.path.getmtime(path))}".encode()
        assert r.file_fp == hashlib.sha1(meta).hexdigest()
        body = open(path, "rb").read()
        mixed = body[:files.CHUNK] + (body[-files.CHUNK:] if len(body) > 2 * files.CHUNK else b"")
        assert deep[path].file_fp == hashlib.sha1(meta + mixed).hexdigest()
    gone = spark.createDataFrame([("/nope", 5, 6)], "path string, size bigint, mtime bigint")
    assert files.with_fingerprint(gone, deep=True).first().file_fp == hashlib.sha1(
        b"/nope|5|6").hexdigest()


def test_normalize_snapshot(spark):
    part = lambda i, f, s: (i, f, s)
    rows = [
        ("1", "movie", "10", "g", ["imdb://tt1", "tmdb://x", "tmdb://55", "tvdb://7"], "Dune",
         "Dune sort", 2021, 1, 2, 3, [([part("p1", "/a", 5), part("p2", "/b", 9)],),
                                      ([part("p3", "/c", 9)],), (None,)],
         "77", 1, 2, 3, 4, 5),
        ("1", "episode", "11", "g2", None, None, None, None, None, None, None, None,
         "77", 1, 2, 3, 4, 5),
        ("1", "show", "12", None, [], "S", "", None, None, None, None,
         [([part("p", "/n", None)],)], "77", 1, 2, 3, 4, 5),
    ]
    got = {r.rating_key: r for r in
           snapshot.normalize_snapshot(spark.createDataFrame(rows, snapshot.RAW_SCHEMA)).collect()}
    film, episode, show = got["10"], got["11"], got["12"]
    assert (film.tmdb_id, film.imdb_id, film.tvdb_id) == (55, "tt1", 7)
    assert (film.part_id, film.source_path, film.source_size) == ("p2", "/b", 9)
    assert film.parent_key is None and film.leaf_count is None and film.sort_title == "Dune sort"
    assert episode.title == "(untitled)" and episode.parent_key == "77"
    assert (episode.season_number, episode.episode_number) == (1, 2)
    assert episode.tmdb_id is None and episode.part_id is None
    assert (show.child_count, show.leaf_count, show.viewed_leaf_count) == (3, 4, 5)
    assert show.sort_title == "S" and show.source_size == 0 and show.season_number is None


def test_payload_tables(spark):
    cache = spark.createDataFrame([
        ("p", "a", "old", 100, 1000), ("p", "a", "new", 200, 10), ("p", "b", "b", 200, 50),
        ("q", "a", "qa", 190, 60)],
        "provider string, cache_key string, payload string, fetched_at bigint, ttl_s bigint")
    fresh = payloads.fresh_payloads(cache, 250).collect()
    assert {(r.provider, r.cache_key, r.payload) for r in fresh} == {
        ("p", "b", "b"), ("q", "a", "qa")}
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (0, 3, "z"), (None, 4, "w")],
                                 "id bigint, seq bigint, v string")
    assert [(r.id, r.v) for r in payloads.keyed(rows, "id", "seq").collect()] == [(1, "y")]
    details = spark.createDataFrame([(1,), (2,)], "file bigint")
    owners = spark.createDataFrame([(2,), (None,)], "ref bigint")
    assert [r.file for r in payloads.wanted(details, "file", owners, "ref").collect()] == [2]


def test_fact_merge_keeps_what_is_not_emitted(spark, registry):
    base = spark.createDataFrame([
        ("a", "video.dar", "2.39", "ffprobe", 1, False),
        ("a", "video.codec", "hevc", "ffprobe", 1, False),
        ("a", "audio.languages", '["eng","fra"]', "ffprobe", 1, False),
        ("b", "video.dar", "1.78", "ffprobe", 1, False),
        ("a", "no.such", "1", "gone", 1, False)], facts.LONG_SCHEMA)
    patch = spark.createDataFrame([
        ("a", "video.dar", "1.85", "ffprobe", 2, False),
        ("a", "audio.languages", '["deu"]', "ffprobe", 2, False),
        ("b", "video.dar", None, "ffprobe", 2, True),
        ("b", "video.interlaced", "false", "ffprobe", 2, False)], facts.LONG_SCHEMA)
    merged = facts.merge(base, patch)
    wide = {r.item_id: r for r in facts.widen(merged, registry).collect()}
    assert wide["a"].video.dar == 1.85 and wide["a"].video.codec == "hevc"
    assert wide["a"].audio.languages == ["deu"]
    assert wide["b"].video.dar is None and wide["b"].video.interlaced is False
    assert wide["b"].audio.languages is None
    # A replayed patch changes nothing.
    assert facts.merge(merged, patch).exceptAll(merged).count() == 0
    specs = registry.for_provider("ffprobe")
    again = facts.to_long(facts.widen(merged, registry), specs, 3)
    assert {(r.item_id, r.key, r.value) for r in again.collect()} == {
        ("a", "video.dar", "1.85"), ("a", "video.codec", "hevc"),
        ("a", "audio.languages", '["deu"]'), ("b", "video.interlaced", "false")}


def test_lay_over(spark):
    old = spark.createDataFrame(
        [("a", (1.0, ["x"])), ("b", (2.0, None))],
        "item_id string, video struct<dar:double,tags:array<string>>")
    new = spark.createDataFrame(
        [("a", (None, ["y"], True), (5,))],
        "item_id string, video struct<dar:double,tags:array<string>,flag:boolean>, "
        "watch struct<plays:int>")
    got = {r.item_id: r for r in facts.lay_over(old, new, ["video", "watch"]).collect()}
    assert got["a"].video.asDict() == {"dar": 1.0, "tags": ["y"], "flag": True}
    assert got["a"].watch.plays == 5 and got["b"].watch is None
    assert got["b"].video.dar == 2.0


PROV = ("item_id string, provider string, schema_version int, input_fp string, "
        "computed_at bigint, status string, reason string")
ITEM = ("item_id string, library_key string, item_type string, deleted_at bigint, "
        "path_status string, local_path string, file_fp string, title string")


def test_staleness_and_scan(spark):
    made = [(str(i), "1", "movie", None, "mapped", f"/m/{i}", f"fp{i}", "t") for i in range(8)]
    made += [("s", "1", "show", None, "unknown", None, None, "t"),
             ("d", "1", "movie", 5, "mapped", "/m/d", "x", "t"),
             ("u", "1", "movie", None, "unmapped", None, None, "t")]
    frame = spark.createDataFrame(made, ITEM)
    prov = spark.createDataFrame([
        ("0", "ffprobe", 1, "fp0", 100, "ok", None), ("1", "ffprobe", 1, "other", 100, "ok", None),
        ("2", "ffprobe", 2, "fp2", 100, "ok", None), ("3", "ffprobe", 1, "fp3", 100, "error", ""),
        ("4", "ffprobe", 1, "fp4", 100, "skipped", ""), ("5", "ffprobe", 1, None, 100, "ok", None),
        ("6", "tmdb", 1, "fp6", 100, "ok", None)], PROV)
    due = {r.item_id for r in staleness.stale(frame, prov, Probe(), 200).collect()}
    assert due == {"1", "2", "3", "4", "5", "6", "7", "u"}
    assert staleness.stale(frame, prov, Probe(), 200, force=True).count() == 9

    class Aged(History):
        max_age_s = 50

    aged = spark.createDataFrame([
        ("0", "tautulli", 1, None, 150, "ok", None), ("1", "tautulli", 1, None, 151, "ok", None)],
        PROV)
    due = {r.item_id for r in staleness.stale(frame, aged, Aged(), 200).collect()}
    assert "0" in due and "1" not in due

    good, bad = staleness.split_eligible(staleness.stale(frame, prov, Probe(), 200), Probe())
    [skip] = bad.collect()
    assert skip.item_id == "u" and "unmapped" in skip.reason and good.count() == 7

    probe = spark.createDataFrame(
        [(str(i), '{"streams":[{"codec_type":"video","width":1920,"height":800}]}')
         for i in range(7)], "item_id string, payload string")
    results = staleness.run(frame, prov, Probe(), {"probe": probe}, 200)
    rows = staleness.provenance_rows(results, Probe(), 200)
    merged = facts.merge_provenance(prov, rows)
    assert merged.count() == 10
    status = {r.item_id: r.status for r in merged.filter("provider = 'ffprobe'").collect()}
    assert status["u"] == "skipped" and status["7"] == "error" and status["1"] == "ok"
    outcome = report.run_outcome(rows).first()
    assert (outcome.eligible, outcome.ok, outcome.errors, outcome.skipped) == (7, 6, 1, 1)
    assert "unmapped" in outcome.skip_reason
    # Errors and skips are due again, nothing else is.
    assert {r.item_id for r in staleness.stale(frame, merged, Probe(), 300).collect()} == {
        "7", "u"}


def test_providers_run_in_the_order_of_their_dependencies(spark, tmp_path):
    providers = [Derived(), Identity(), Probe()]
    assert [p.id for p in staleness.in_order(providers)][-1] == Derived.id

    class Circle(Probe):
        depends_on = ("derived",)
    circle = Circle()
    circle.depends_on = ("derived", "ffprobe")
    with pytest.raises(ValueError, match="depend on each other"):
        staleness.in_order([circle])

    frame = spark.createDataFrame(
        [(k, "1", "movie", None, "mapped", f"/m/{k}", f"fp-{k}", k, 1980, None, None, 6_000_000, 5) for k in "xy"],
        ITEM + ", year int, added_at bigint, updated_at bigint, duration_ms bigint, tmdb_id bigint")
    probe = spark.createDataFrame(
        [(k, '{"format":{"duration":"6060"},"streams":[{"codec_type":"video","width":1920,"height":800}]}')
         for k in "xy"], "item_id string, payload string")
    films = spark.createDataFrame([(5, '{"title": "t", "runtime": 90}')], "tmdb_id bigint, payload string")
    runs = []

    def keep(provider, results):
        runs.append(provider.id)
        path = str(tmp_path / f"{len(runs)}-{provider.id}")
        results.write.parquet(path)
        return spark.read.parquet(path)
    none = spark.createDataFrame([], PROV)
    items, provenance = staleness.run_all(frame, none, [Derived(), Identity(), Film(), Probe()], {"probe": probe, "films": films}, 500, keep)
    got = {r.item_id: r for r in items.collect()}
    assert got["x"].derived.resolution_class == "1080p" and got["x"].derived.runtime_mismatch_min == 1.0
    assert got["y"].derived.runtime_vs_tmdb_min == 11.0 and runs[-1] == "derived" and len(runs) == 4
    assert provenance.filter("status = 'ok'").count() == 8


def test_input_fingerprint_follows_every_input(spark):
    frame = spark.createDataFrame([(1.0, None), (1.0, "x"), (2.0, "x")], "a double, b string")
    got = [r[0] for r in frame.select(
        staleness.input_fingerprint(F.col("a"), F.col("b"))).collect()]
    assert got[0] == hashlib.sha1(b"1.0|None").hexdigest() and len(set(got)) == 3


def test_coverage_and_stats(spark):
    frame = spark.createDataFrame(
        [(str(i), "1", "movie" if i < 3 else "episode", None, "mapped", "/x", f"fp{i}", "t")
         for i in range(5)] + [("s", "1", "show", None, "unknown", None, None, "t"),
                               ("d", "1", "movie", 9, "missing", None, None, "t")], ITEM)
    prov = spark.createDataFrame(
        [("0", "ffprobe", 1, "fp0", 1, "ok", None), ("1", "ffprobe", 1, "old", 1, "ok", None),
         ("3", "ffprobe", 1, "fp3", 1, "error", None), ("4", "ffprobe", 1, None, 1, "skipped", ""),
         ("d", "ffprobe", 1, None, 1, "ok", None), ("0", "plex", 1, "zz", 1, "ok", None),
         ("0", "unknown", 1, None, 1, "ok", None)], PROV)
    got = {(r.provider, r.item_type): r for r in
           report.coverage(frame, prov, default_providers()).collect()}
    def tell(key):
        r = got[key]
        return r.known, r.errors, r.skipped, r.stale, r.total
    assert tell(("ffprobe", None)) == (2, 1, 1, 1, 5)
    assert tell(("ffprobe", "movie")) == (2, 0, 0, 1, 3)
    assert tell(("ffprobe", "episode")) == (0, 1, 1, 0, 2)
    assert tell(("plex", None)) == (1, 0, 0, 0, 6) and tell(("plex", "show")) == (0, 0, 0, 0, 1)
    assert tell(("sonarr", None)) == (0, 0, 0, 0, 1)
    assert len({k[0] for k in got}) == 8 and ("unknown", None) not in got
    stats = {r.path_status: (r.total, r.with_facts, r.deleted) for r in report.stats(
        frame, F.col("file_fp").isNotNull()).collect()}
    assert stats == {"mapped": (5, 5, 0), "unknown": (1, 0, 0), "missing": (0, 0, 1)}


def test_browse(spark, registry):
    frame = spark.createDataFrame([
        (str(i), t, t, 2000 + i, "movie", "mapped", None, f"fp{i}", (2.0, None), (tags,))
        for i, (t, tags) in enumerate([("beta", ["x", "Y"]), ("Alpha", ["x"]), ("100%", None),
                                       ("gamma a", [])])],
        "item_id string, title string, sort_title string, year int, item_type string, "
        "path_status string, deleted_at bigint, file_fp string, "
        "video struct<dar:double,codec:string>, audio struct<languages:array<string>>")
    page = browse.items(frame, registry, limit=2, offset=1, columns=["title"]).collect()
    assert [(r.title, r.fact_count) for r in page] == [("Alpha", 2), ("beta", 2)]
    found = browse.items(frame, registry, q="A", sort="year", descending=True)
    assert [r.title for r in found.collect()] == ["gamma a", "Alpha", "beta"]
    assert browse.items(frame, registry, q="%", columns=["title"]).first().title == "100%"
    assert browse.total(frame, q="a").first().total == 3
    with pytest.raises(ValueError):
        browse.items(frame, registry, item_type="book")
    prov = spark.createDataFrame(
        [("0", "ffprobe", 1, "old", 1, "ok", None), ("0", "derived", 1, None, 1, "ok", None)], PROV)
    assert [(r.provider, r.stale) for r in browse.detail(frame, prov, "0").collect()] == [
        ("derived", False), ("ffprobe", True)]
    vocabulary = spark.createDataFrame([("y",), ("Zulu",), ("zulu",), ("x1",)], "value string")
    listed = words("audio.languages")
    got = [(r.value, r.n) for r in browse.values(frame, listed, vocabulary=vocabulary).collect()]
    assert got == [("x", 2), ("Y", 1), ("Zulu", 0), ("x1", 0)]
    assert [(r.value, r.n) for r in browse.values(
        frame, listed, "X", 2, vocabulary).collect()] == [("x", 2), ("x1", 0)]
    assert browse.values(frame, text("video.codec")).count() == 0


@pytest.mark.parametrize("sort,descending", [
    (sort, down) for sort in ("title", "year", "size") for down in (False, True)])
def test_pages_by_cursor_are_pages_by_offset(spark, registry, sort, descending):
    frame = spark.createDataFrame([
        (i, title, title, year, size, "movie", None)
        for i, (title, year, size) in enumerate([
            ("b", 2000, 5), ("B", None, 5), (None, None, None), ("a", 1999, 5), ("c", 2000, None),
            ("a", 2001, 7), (None, 2000, 5)])],
        "item_id int, title string, sort_title string, year int, file_size bigint, "
        "item_type string, deleted_at bigint")
    whole = [r.item_id for r in browse.items(
        frame, registry, sort=sort, descending=descending, columns=["item_id"]).collect()]
    assert sorted(whole) == list(range(7))
    for size in (1, 3):
        seen, after = [], None
        while True:
            page = browse.items(frame, registry, sort=sort, descending=descending, limit=size,
                                columns=["item_id"], after=after, with_cursor=True).collect()
            if not page:
                break
            seen += [r.item_id for r in page]
            after = page[-1].cursor
        assert seen == whole
    with pytest.raises(ValueError):
        browse.items(frame, registry, offset=2, after=(None, 1))


def test_scope(spark):
    frame = spark.createDataFrame(
        [("1", "movie", None), ("2", "movie", None), ("1", "show", None), ("1", "movie", 3)],
        "library_key string, item_type string, deleted_at bigint")
    assert scope(frame).count() == 2
    assert scope(frame, ["1"]).count() == 1
    assert scope(frame, types=[]).count() == 3


def test_registry(spark, registry):
    class Twice(Identity):
        id = "again"
    with pytest.raises(ValueError, match="plex"):
        registry.register(Twice())
    assert len(registry.specs()) == 124
    assert registry.require("audio.codec").applies_to == ("movie", "episode")
    described = {r.key: r for r in registry.describe_df(spark).collect()}
    assert described["video.dar"].aggregates == ["percentile", "median", "mean", "min", "max"]
    assert described["video.codec"].aggregates == []
    assert "contains_all" in described["tmdb.keywords"].operators
    assert registry.schema()["video"].dataType["dar"].dataType.simpleString() == "double"
    assert Derived().facts[0].namespace == "derived"


def test_fact_table(spark, tmp_path):
    path, packed = str(tmp_path / "facts"), str(tmp_path / "packed")
    rows = lambda *r: spark.createDataFrame(list(r), facts.LONG_SCHEMA)
    first = rows(("a", "x.a", "1", "p", 1, False), ("a", "x.b", "2", "p", 1, False))
    facts.write_patch(first, path, 1)
    second = rows(("a", "x.a", None, "p", 2, True), ("b", "x.a", "5", "p", 2, False))
    for _ in range(2):
        facts.write_patch(second, path, 2)
    assert facts.read_patches(spark, path).count() == 4

    def stored(where):
        return {(r.item_id, r.key, r.value) for r in facts.read_merged(spark, where).collect()}

    assert stored(path) == {("a", "x.b", "2"), ("b", "x.a", "5")}
    facts.compact(spark, path, packed, 2)
    assert stored(packed) == stored(path) and facts.read_patches(spark, packed).count() == 2


def test_walk_finds_empty_files(spark, tmp_path):
    deep = tmp_path / "root" / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "root" / "void").mkdir()
    for folder, name, content in ((deep, "empty.mkv", ""), (deep, ".hidden", "x"), (deep.parent, "one.mkv", "123"),
                                  (tmp_path / "root", "note.txt", "é")):
        (folder / name).write_text(content)
    from workloads.base import scratch
    scratch(spark, "walk")  # names a shared folder where the session has none
    found = {(r.path[len(str(tmp_path)):], r.size) for r in files.manifest(spark, str(tmp_path / "root"), mounted=True).collect()}
    assert found == {("/root/a/b/empty.mkv", 0), ("/root/a/one.mkv", 3), ("/root/note.txt", 2)}
    films = files.manifest(spark, f"file:{tmp_path}/root", "*.mkv", mounted=True)
    items = spark.createDataFrame([(1, "/m/a/b/empty.mkv"), (2, "/m/a/gone.mkv")], "item_id int, source_path string")
    status = {r.item_id: r.path_status for r in paths.resolve(items, [("/m", f"{tmp_path}/root")], films).collect()}
    assert status == {1: "mapped", 2: "missing"}
    assert files.manifest(spark, str(tmp_path / "nowhere"), mounted=True).collect() == []


def test_ranges_and_joins_place_paths_alike(spark):
    import random
    rng = random.Random(11)
    name = lambda: rng.choice(["a", "b", "ab", "a-", "a.", "é", "", ".", "A"])
    made = lambda sep, n: sep.join(name() for _ in range(rng.randint(1, n)))
    mappings = [("/", "/root"), ("/a", "/x"), ("/a/b", None), (None, "/y")]
    mappings += [(rng.choice(["/", ""]) + made("/", 3), f"/l{i}") for i in range(30)]
    mappings += [("C:\\" + made("\\", 3), f"/w{i}") for i in range(20)]
    rows = [(i, rng.choice(["/", "", "C:\\", "c:\\"]) + made(rng.choice("/\\"), 5)) for i in range(600)]
    items = spark.createDataFrame(rows + [(-1, None), (-2, "")], "item_id int, source_path string")
    for some in (mappings, mappings[:1], mappings[1:3], mappings[40:], []):
        some = spark.createDataFrame(some, "source string, local string")
        by = {most: paths.Prefixes.of(spark, some, most) for most in (0, 100)}
        found = [sorted(map(repr, paths.translate(items, p).collect())) for p in by.values()]
        assert found[0] == found[1] and len(found[0]) == len(rows) + 2


def test_nested_prefixes_are_disjoint_ranges():
    starts, owner = paths._ranges({"/a": 0, "/a/b": 1}, "/")
    place = lambda text: owner[max(i for i, s in enumerate(starts) if s <= text)] if text >= starts[0] else -1
    assert [place(t) for t in ("/", "/a", "/a-", "/a.", "/a/", "/a/b", "/a/b!", "/a/b/c", "/a/b0", "/a/c", "/a0", "/b")] == [
        -1, 0, -1, -1, 0, 1, 0, 1, 0, 0, -1, -1]


def test_stored_reconcile_counts_what_it_writes(spark, tmp_path):
    from factloom.operators import reconcile
    schema = ("item_id string, library_key string, item_type string, rating_key string, guid string, title string, "
              "first_seen bigint, last_seen bigint, seen_run bigint, deleted_at bigint")
    old = spark.createDataFrame([("i1", "1", "movie", "k1", "g1", "One", 1, 1, 1, None),
                                 ("i2", "1", "movie", "k2", "g2", "Two", 1, 1, 1, None),
                                 ("i3", "2", "movie", "k3", "g3", "Three", 1, 1, 1, None)], schema)
    new = spark.createDataFrame([("1", "k1", "g1", "One!"), ("1", "k9", "g2", "Two"), ("1", "k5", "g5", "Five")],
                                "library_key string, rating_key string, guid string, title string")
    written, seen = reconcile.store(old, new, ["1"], 50, 9, str(tmp_path / "catalogue"))
    rows, counts = reconcile.apply(old, new, ["1"], 50, 9)
    assert seen == counts.first().asDict() and seen["added"] == seen["rotated"] == seen["updated"] == 1
    assert sorted(map(repr, written.select(rows.columns).collect())) == sorted(map(repr, rows.collect()))


def test_stores_keep_their_buckets_and_repeat_runs(spark, tmp_path):
    from factloom.operators.store import Store
    path = str(tmp_path / "store")
    schema = "item_id string, key string, value string, seq bigint"
    store = Store.open(spark, path, schema, ("item_id", "key"), "seq", 3)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    store.put(rows(("a", "k", "old", 1), (None, "k", "no item", 1), ("b", "k", "same", 5)), 1)
    store.put(rows(("a", "k", "new", 2), ("b", "k", "later", 5), ("c", None, "no key", 2)), 2)
    newest = {("a", "k", "new"), (None, "k", "no item"), ("b", "k", "later"), ("c", None, "no key")}
    found = lambda frame: {(r.item_id, r.key, r.value) for r in frame.collect()}
    assert found(store.merged()) == newest
    # as another session finds it
    spark.sql(f"DROP TABLE {store.table}")
    again = Store.open(spark, path, schema, ("item_id", "key"), "seq")
    assert again.buckets == 3 and found(again.merged()) == newest
    assert found(again.merged(rows(("a", "k", "newest", 2), ("d", "k", "x", 0)))) == (
        newest - {("a", "k", "new")} | {("a", "k", "newest"), ("d", "k", "x")})
    again.put(rows(), 2)
    assert found(again.merged()) == {("a", "k", "old"), (None, "k", "no item"), ("b", "k", "same")}
    with pytest.raises(ValueError, match="3 buckets"):
        Store.open(spark, path, schema, ("item_id", "key"), "seq", 4)


def test_rows_without_a_key_are_spread_and_never_match(spark):
    from factloom.functions.joins import left_lookup
    left = spark.createDataFrame(
        [(i, None if i % 2 else i) for i in range(1000)], "item_id int, k bigint")
    right = spark.createDataFrame([(i, "v") for i in range(-2000, 500)], "k bigint, v string")
    found = left_lookup(left, right, ["k"], "item_id")
    assert found.count() == 1000 and found.columns == ["item_id", "k", "v"]
    assert found.filter("v is not null").count() == 250
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = left_lookup(left, right, ["k"], "item_id").withColumn(
            "p", F.spark_partition_id()).filter("k is null").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(plain) == 4 and max(r["count"] for r in plain) < 250
