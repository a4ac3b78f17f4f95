"""Text windows, audio frames, image augmentation choices, video clips and byte-range plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.wrap64 import unit
from tidemill.operators.manifest import hint_field, truthy


def window_starts(length: Column, width: int, stride: int) -> Column:
    """The starts of the windows over `length` items; one window for none."""
    n = F.lit(1) + F.greatest(F.lit(0), F.least(F.ceil(length / stride) - 1, F.ceil(F.greatest(length - width, F.lit(0)) / stride)))
    return F.sequence(F.lit(0).cast("long"), (n - 1) * stride, F.lit(stride).cast("long"))


def text_windows(rows: DataFrame, tokens: str, width: int, stride: int, pad: int) -> DataFrame:
    """(.., window_no, token_ids, mask): windows of fixed width, padded to the right."""
    wide = rows.select("*", F.posexplode(window_starts(F.size(tokens).cast("long"), width, stride)).alias("window_no", "start"))
    part = F.slice(tokens, (F.col("start") + 1).cast("int"), width)
    cut = wide.withColumn("part", part)
    fill = F.lit(width) - F.size("part")
    return cut.select(*(c for c in rows.columns if c != tokens), "window_no", F.concat("part", F.array_repeat(F.lit(pad).cast("long"), fill)).alias("token_ids"), F.concat(F.array_repeat(F.lit(1), F.size("part")), F.array_repeat(F.lit(0), fill)).alias("mask"))


def clip_id(manifest: str, media_id: Column, uri: Column, stream: Column, start: Column, clip: int, stride: int, policy: str, seed: int, epoch: int) -> Column:
    """What a clip is known by everywhere: the SHA-256 of all that makes it."""
    parts = [F.lit(manifest), media_id, uri, stream, start, F.lit(clip), F.lit(stride), F.lit(policy), F.lit(seed), F.lit(epoch)]
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def padded(samples: Column, n: int, zero: Column) -> Column:
    return F.slice(F.concat(samples, F.array_repeat(zero, n)), 1, n)


def pcm(value: Column, bits: int) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value / F.lit(float(1 << (bits - 1)))))


def downmixed(samples: Column, channels: int) -> Column:
    """The mean over interleaved channels, between -1 and 1; null where the length doesn't divide."""
    frame = F.sequence(F.lit(0), (F.size(samples) / channels).cast("int") - 1)
    mean = F.transform(frame, lambda f: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.slice(samples, f * channels + 1, channels), F.lit(0.0), lambda a, x: a + x) / channels)))
    return F.when(F.pmod(F.size(samples), F.lit(channels)) != 0, None).when(F.size(samples) == 0, F.array().cast("array<double>")).otherwise(mean)


def crop_start(most: int, u: Column) -> Column:
    return F.least(F.floor(F.lit(most + 1).cast("float") * u), F.lit(most)).cast("int")


def augmentation(ids: DataFrame, run: int, seed: int, epoch: int, height: int, width: int, crop: int, flip: float, strength: float | tuple[float, float, float]) -> DataFrame:
    """(sample_id, top, left, flip, brightness, contrast, saturation): what a sample's augmentation does, the same on every machine."""
    u = lambda stream: unit(run, seed, F.col("sample_id"), stream, epoch)
    of = dict(zip((11, 12, 13), strength if isinstance(strength, tuple) else (strength,) * 3, strict=True))
    factor = lambda stream: F.lit(1.0).cast("float") + (u(stream) * F.lit(2.0).cast("float") - F.lit(1.0).cast("float")) * F.lit(of[stream]).cast("float")
    return ids.select("sample_id", crop_start(height - crop, u(1)).alias("top"), crop_start(width - crop, u(2)).alias("left"), (u(3) < F.lit(flip).cast("float")).alias("flip"), factor(11).alias("brightness"), factor(12).alias("contrast"), factor(13).alias("saturation"))


def media_state(hint: Column, clip: int) -> Column:
    """Null for media that give clips, else why they don't; the first that holds."""
    frames, stream = (hint_field(hint, k).try_cast("long") for k in ("frames", "stream_id"))
    return F.when(hint.isNull(), "missing_stream").when(F.coalesce(truthy(hint_field(hint, "corrupt")), F.lit(False)), "corrupt_media").when(hint_field(hint, "codec") == "unsupported", "unsupported_codec").when(frames.isNull() | stream.isNull(), "missing_stream").when(frames < clip, "short_media")


def clips(media: DataFrame, clip: int, stride: int) -> DataFrame:
    """(media_id, clip_start) of media (media_id, frames) that have clips."""
    return media.filter(F.col("frames") >= clip).select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - clip, F.lit(stride).cast("long"))).alias("clip_start"))


def faulty_chunks(chunks: DataFrame, *by: str) -> DataFrame:
    """(media_id, n_chunks, faults, keyframes, valid) for sidecars of chunks; by: what tells sidecars apart, if it is more than the medium."""
    by = by or ("media_id",)
    w = Window.partitionBy(*by).orderBy("chunk_index")
    before = lambda c: F.lag(c).over(w)
    bad = (F.col("start_ms") >= F.col("end_ms")) | (F.col("start_byte") >= F.col("end_byte")) | F.coalesce(F.col("start_ms") < before("end_ms"), F.lit(False)) | F.coalesce(F.col("start_byte") < before("end_byte"), F.lit(False)) | F.coalesce(F.col("chunk_index") <= before("chunk_index"), F.lit(False))
    seen = chunks.withColumn("bad", bad).groupBy(*by).agg(F.count("*").alias("n_chunks"), F.sum(F.col("bad").cast("long")).alias("faults"), F.sum("keyframe").cast("long").alias("keyframes"))
    return seen.withColumn("valid", (F.col("faults") == 0) & (F.col("keyframes") > 0))


def range_plan(chunks: DataFrame, starts: DataFrame, most: int, gap: int) -> DataFrame:
    """(media_id, clip_id, anchor_ms, n_ranges, first_byte, last_byte, planned_bytes) for clips (media_id, clip_id, clip_start_ms, clip_end_ms).

    The anchor is the last keyframe that starts by the clip, else the first. Chunks from there to the clip's end are merged where no
    more than `gap` bytes lie between, then across the smallest gaps until `most` ranges are left: of the gaps, the largest most - 1
    stay, so the plan is one window over each clip's chunks, not a loop. Clips of one medium are planned each by itself.
    """
    clip = ["media_id", "clip_id"]
    both = chunks.join(starts, "media_id")
    key = Window.partitionBy(*clip)
    anchored = both.withColumn("anchor_ms", F.coalesce(F.max(F.when((F.col("keyframe") == 1) & (F.col("start_ms") <= F.col("clip_start_ms")), F.col("start_ms"))).over(key), F.min(F.when(F.col("keyframe") == 1, F.col("start_ms"))).over(key)))
    taken = anchored.filter((F.col("start_ms") >= F.col("anchor_ms")) & (F.col("start_ms") < F.col("clip_end_ms")))
    order = Window.partitionBy(*clip).orderBy("chunk_index")
    space = taken.withColumn("space", F.col("start_byte") - F.lag("end_byte").over(order)).withColumn("cut", F.col("space") > gap)
    kept = F.row_number().over(Window.partitionBy(*clip, F.coalesce("cut", F.lit(False))).orderBy(F.desc("space"), F.desc("chunk_index"))) <= most - 1
    parts = space.withColumn("opens", (F.coalesce("cut", F.lit(False)) & kept) | F.col("space").isNull()).withColumn("part", F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy(*clip, "anchor_ms", "part").agg(F.min("start_byte").alias("a"), F.max("end_byte").alias("b"))
    return merged.groupBy(*clip, "anchor_ms").agg(F.count("*").alias("n_ranges"), F.min("a").alias("first_byte"), F.max("b").alias("last_byte"), F.sum(F.col("b") - F.col("a")).alias("planned_bytes"))
