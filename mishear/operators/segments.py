"""Speech segments of frames, and merging of ranges: gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(active: DataFrame, track: str, start: str, end: str, gap) -> DataFrame:
    """Active frames (track, start, end) joined into sessions where silence stays below ``gap``.

    A session ends at its last active frame; silence of ``gap`` or more begins another.
    """
    w = Window.partitionBy(track).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) - before >= gap), 1).otherwise(0)
    numbered = active.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(track, F.col("_island").alias("island")).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("frames"))


def pad(sessions: DataFrame, least, padding, duration: Column) -> DataFrame:
    """Drops short sessions, pads the others on both sides within the track."""
    kept = sessions.where(F.col("end") - F.col("start") >= least)
    return kept.withColumns({"start": F.greatest(F.lit(0), F.col("start") - padding), "end": F.least(duration, F.col("end") + padding)})


def merge(ranges: DataFrame, track: str, gap) -> DataFrame:
    """Ranges whose distance is at most ``gap`` become one."""
    return islands(ranges, track, "start", "end", F.lit(gap) + 1).withColumnRenamed("frames", "parts")


def speech(frames: DataFrame, track: str, threshold: float, silence: int = 500, least: int = 200, padding: int = 100, gap: int = 100) -> DataFrame:
    """(track, start, end) of speech in frames (track, start, end, energy, duration): sessions, padded, those that meet merged."""
    active = frames.where(F.col("energy") >= threshold)
    sessions = islands(active, track, "start", "end", silence)
    lengths = frames.groupBy(track).agg(F.max("end").alias("duration"))
    padded = pad(sessions.join(lengths, track), least, padding, F.col("duration"))
    return merge(padded.select(track, "start", "end"), track, gap).select(track, "start", "end")


def segments(pcm: DataFrame, ranges: DataFrame, track: str, bytes_per_ms: int = 32) -> DataFrame:
    """Byte-exact slices of 16-bit samples with their digests."""
    joined = pcm.join(ranges, track)
    cut = joined["pcm"].substr(F.col("start") * bytes_per_ms + 1, (F.col("end") - F.col("start")) * bytes_per_ms)
    return joined.withColumn("segment", cut).withColumn("sha256", F.sha2("segment", 256)).drop("pcm")
