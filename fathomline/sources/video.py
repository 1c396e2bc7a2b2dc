"""Captured caption tracks and the ids of videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, unescaped
from ..functions.url import host_of, path_of

_ID = r"[A-Za-z0-9_\-]{11}"
# First parts of paths that a video's id follows.
KINDS = ["shorts", "embed", "live", "v"]


def video_id(target: Column) -> Column:
    """The id that a bare id or a URL of any common form names; null for anything else."""
    said = F.trim(target)
    url = F.when(said.contains("//"), said).otherwise(F.concat(F.lit("https://"), said))
    host = F.regexp_replace(host_of(url), r"^(?:www|m|music)\.", "")
    path = path_of(url)
    short = F.regexp_extract(path, f"^/*({_ID})/*$", 1)
    watched = F.when(path.rlike("^/+watch/*$"), F.regexp_extract(url, rf"[?&]v=({_ID})(?:[&#]|$)", 1)).otherwise(F.regexp_extract(path, rf"^/+(?:{'|'.join(KINDS)})/+({_ID})(?:/|$)", 1))
    found = F.when(said.rlike(f"^{_ID}$"), said).when(host == "youtu.be", short).when(host.isin("youtube.com", "youtube-nocookie.com"), watched)
    return F.nullif(found, F.lit(""))


def caption_segments(tracks: DataFrame) -> DataFrame:
    """(video_id, pos, start, end, text) of caption tracks (video_id, body), which are JSON events or WebVTT; times in seconds to two places, empty lines left out."""
    shape = "events array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>"
    event = F.from_json("body", shape)["events"]
    said = lambda e: F.array_join(F.transform(F.coalesce(e["segs"], F.array().cast("array<struct<utf8:string>>")), lambda s: s["utf8"]), "")
    from_json = F.transform(event, lambda e: F.named_struct(F.lit("s"), e["tStartMs"] / 1000, F.lit("e"), (e["tStartMs"] + F.coalesce(e["dDurationMs"], F.lit(0.0))) / 1000, F.lit("t"), said(e)))
    stamp = r"(?:(\d+):)?(\d{1,2}):(\d{1,2}[.,]\d{1,3})"
    seconds = lambda line, at: F.coalesce(F.regexp_extract(line, stamp + r"\s+-->\s+" + stamp, at).try_cast("double"), F.lit(0.0)) * 3600 + F.regexp_extract(line, stamp + r"\s+-->\s+" + stamp, at + 1).try_cast("double") * 60 + F.replace(F.regexp_extract(line, stamp + r"\s+-->\s+" + stamp, at + 2), F.lit(","), F.lit(".")).try_cast("double")
    cues = F.filter(F.split(F.regexp_replace("body", r"\r\n?", "\n"), r"\n{2,}"), lambda c: c.contains("-->"))
    from_vtt = F.transform(cues, lambda c: F.named_struct(F.lit("s"), seconds(c, 1), F.lit("e"), seconds(c, 4), F.lit("t"), F.regexp_replace(F.regexp_replace(c, r"(?s)\A.*?-->[^\n]*\n?", ""), "<[^<>]++>", "")))
    rows = tracks.select("video_id", F.posexplode(F.when(F.ltrim("body").startswith("{"), from_json).otherwise(from_vtt)).alias("pos", "c"))
    clean = rows.select("video_id", "pos", F.round("c.s", 2).alias("start"), F.round("c.e", 2).alias("end"), folded(unescaped(F.coalesce("c.t", F.lit("")))).alias("text"))
    return clean.where("text <> ''")


def transcripts(segments: DataFrame) -> DataFrame:
    """(video_id, url, segment_count, duration_s, text): the segments of each video as one text, in order."""
    rolled = segments.groupBy("video_id").agg(F.count(F.lit(1)).alias("segment_count"), F.max_by("end", "pos").alias("duration_s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("text"))
    return rolled.select("video_id", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url"), "segment_count", "duration_s", "text")
