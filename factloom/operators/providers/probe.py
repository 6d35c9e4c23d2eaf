"""Facts from the JSON that a media prober prints for a file."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ...functions.joins import left_lookup
from ...functions.scalars import emitted, filled, sorted_set, truthy, yes
from ...functions.spec import enum, flag, measure, number, text, words
from ...sources.payloads import PROBE_SCHEMA, parse
from .base import Provider

# Standard ratios with their labels, first match wins, and the tolerance.
RATIOS = (
    (1.33, "1.33:1"), (1.37, "1.37:1"), (1.66, "1.66:1"), (1.78, "1.78:1"), (1.85, "1.85:1"),
    (2.00, "2.00:1"), (2.20, "2.20:1"), (2.35, "2.35:1"), (2.39, "2.39:1"), (2.76, "2.76:1"),
)
TOLERANCE = 0.015
# Channel counts that have a name of their own.
LAYOUTS = {1: "mono", 2: "stereo", 6: "5.1", 8: "7.1"}
DOLBY_RECORD = "DOVI configuration record"
TRANSFERS = {"smpte2084": "hdr10", "arib-std-b67": "hlg"}


def ratio_bucket(ratio: Column) -> Column:
    """The first standard ratio within the tolerance, else ``other``."""
    bucket = F
    for value, label in RATIOS:
        bucket = bucket.when(F.abs(ratio - value) / value <= TOLERANCE, label)
    return F.when(ratio.isNotNull(), bucket.otherwise("other"))


def ratio_of(written: Column, default: float) -> Column:
    """``W:H`` as a number; the default when it is malformed or has a zero."""
    w = F.substring_index(written, ":", 1).try_cast("double")
    h = F.substr(written, F.length(F.substring_index(written, ":", 1)) + 2).try_cast("double")
    value = F.when(written.contains(":") & (w != 0), F.try_divide(w, h))
    return F.coalesce(value, F.lit(float(default)))


def rate_of(written: Column) -> Column:
    """Frames per second from ``n/d``, 3 decimals; NULL unless positive."""
    n, d = (F.get(F.split(written, "/"), F.lit(i)).try_cast("double") for i in (0, 1))
    value = F.try_divide(n, d)
    return F.when(value > 0, F.round(value, 3))


def hdr_format(video: Column) -> Column:
    records = F.filter(
        F.coalesce(video["side_data_list"],
                   F.array().cast("array<struct<side_data_type:string,dv_profile:int>>")),
        lambda s: s["side_data_type"] == DOLBY_RECORD)
    profile = F.get(records, F.lit(0))["dv_profile"]
    plain = F
    for transfer, label in TRANSFERS.items():
        plain = plain.when(video["color_transfer"] == transfer, label)
    return (
        F.when(F.size(records) > 0,
               F.coalesce(F.concat(F.lit("dv_p"), profile.cast("string")), F.lit("dv")))
        .otherwise(plain.otherwise("sdr"))
    )


def layout(channels: Column) -> Column:
    named = F
    for count, label in LAYOUTS.items():
        named = named.when(channels == count, label)
    return named.when(channels != 0, F.concat(channels.cast("string"), F.lit("ch"))).otherwise(
        "unknown")


def is_commentary(stream: Column) -> Column:
    tags = F.map_filter(stream["tags"], lambda k, v: F.lower(k) == "title")
    titled = F.exists(F.map_values(tags), lambda v: F.lower(v).contains("commentary"))
    return yes(titled) | yes(F.try_element_at(stream["disposition"], F.lit("comment")) == 1)


def _languages(streams: Column) -> Column:
    return sorted_set(F.transform(streams, lambda s: F.coalesce(
        F.try_element_at(s["tags"], F.lit("language")), F.lit("und"))))


class Probe(Provider):
    id = "ffprobe"
    file_fingerprinted = True
    applies_to = ("movie", "episode")
    # Keys, types, enum values.
    facts = (
        measure("video.dar", unit="ratio"),
        enum("video.aspect_bucket", *[label for _, label in RATIOS], "other", folded=True),
        measure("video.width", unit="px"),
        measure("video.height", unit="px"),
        number("video.sar"),
        text("video.codec"),
        enum("video.hdr_format", "sdr", "hdr10", "hlg", "dv", "dv_p4", "dv_p5", "dv_p7",
             "dv_p8", "dv_p9", folded=True),
        number("video.bit_depth", unit="bit"),
        measure("video.fps", unit="fps"),
        flag("video.interlaced"),
        text("audio.codec"),
        measure("audio.channels"),
        enum("audio.layout", "mono", "stereo", "5.1", "7.1", "unknown", "3ch", "4ch", "10ch",
             "12ch", folded=True),
        measure("audio.track_count"),
        words("audio.languages"),
        flag("audio.has_commentary"),
        measure("subs.track_count"),
        words("subs.languages"),
        flag("subs.has_forced"),
        measure("file.duration_s", unit="s"),
        measure("file.size_bytes", unit="B"),
        measure("file.bitrate_kbps", unit="kbps"),
        text("file.container"),
    )

    def ineligible(self):
        readable = (F.col("path_status") == "mapped") & filled(F.col("local_path")).isNotNull()
        return F.when(~yes(readable), F.concat(
            F.lit("file not readable (path "), F.col("path_status"), F.lit(")")))

    def fingerprint(self):
        return F.col("file_fp")

    def compute(self, items, sources):
        """``sources["probe"]``: (item_id, payload)."""
        probed = left_lookup(
            items, parse(sources["probe"], PROBE_SCHEMA).select("item_id", "doc", "payload"),
            ["item_id"], "item_id")
        streams = F.col("doc.streams")

        def of(kind):
            return F.coalesce(
                F.filter(streams, lambda s: s["codec_type"] == kind), F.slice(streams, 1, 0))

        probed = probed.withColumns({
            "video": F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0)),
            "_audio": of("audio"),
            "_subs": of("subtitle"),
        }).withColumn("main", F.coalesce(
            F.get(F.filter("_audio", lambda s: F.try_element_at(
                s["disposition"], F.lit("default")) == 1), F.lit(0)),
            F.get("_audio", F.lit(0))))
        video, main = F.col("video"), F.col("main")
        audio, subs, box = F.col("_audio"), F.col("_subs"), F.col("doc.format")

        sar = ratio_of(video["sample_aspect_ratio"], 1.0)
        declared = ratio_of(video["display_aspect_ratio"], 0.0)
        framed = truthy(video["width"]) & truthy(video["height"])
        dar = F.round(F.when(declared != 0, declared).otherwise(
            F.try_divide(video["width"], video["height"]) * sar), 4)
        bits = F.coalesce(filled(video["bits_per_raw_sample"]),
                          filled(video["bits_per_coded_sample"]))
        heard = F.size(audio) > 0

        made = {
            "video.dar": emitted(framed, dar),
            "video.aspect_bucket": emitted(framed, ratio_bucket(dar)),
            "video.width": emitted(framed, video["width"]),
            "video.height": emitted(framed, video["height"]),
            "video.sar": F.round(sar, 4),
            "video.codec": video["codec_name"],
            "video.hdr_format": hdr_format(video),
            "video.bit_depth": bits.try_cast("int"),
            "video.fps": F.coalesce(rate_of(video["avg_frame_rate"]),
                                    rate_of(video["r_frame_rate"])),
            "video.interlaced": ~F.coalesce(
                video["field_order"].isin("progressive", "unknown"), F.lit(True)),
            "audio.codec": main["codec_name"],
            "audio.channels": main["channels"],
            "audio.layout": emitted(heard, layout(main["channels"])),
            "audio.track_count": F.size(audio),
            "audio.languages": _languages(audio),
            "audio.has_commentary": emitted(heard, F.exists(audio, is_commentary)),
            "subs.track_count": F.size(subs),
            "subs.languages": _languages(subs),
            "subs.has_forced": F.exists(subs, lambda s: yes(
                F.try_element_at(s["disposition"], F.lit("forced")) == 1)),
            "file.duration_s": F.round(box["duration"].try_cast("double"), 2),
            "file.size_bytes": box["size"].try_cast("bigint"),
            "file.bitrate_kbps": F.round(box["bit_rate"].try_cast("bigint") / 1000, 1),
            "file.container": box["format_name"],
        }
        reason = (
            F.when(F.col("payload").isNull(), "no probe output")
            .when(streams.isNull() & box.isNull(), "unparseable probe output")
            .otherwise("no video stream found"))
        return self.results(
            probed, made, F.when(video.isNotNull(), "ok").otherwise("error"), reason)
