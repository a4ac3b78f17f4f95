"""The ways in: from a dataset link to batches of samples, of text, audio, images or clips, and to a mix of several; each returns DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.wrap64 import fnv1a
from tidemill.operators import audio as _audio
from tidemill.operators import batching, control, images, manifest, media, mixing, packing, payloads, ranges, resume, transforms, video
from tidemill.operators import text as _text
from tidemill.operators.transforms import transform
from tidemill.plans.lineage import shared_folder
from tidemill.sources import resolvers, snapshot

__all__ = ["audio", "image", "load", "mix", "pack", "pack_folder", "resolve", "stats", "text", "transform", "video_clips"]
pack, pack_folder = packing.pack, packing.pack_folder


def store(spark: SparkSession, root: str | None = None) -> snapshot.Store:
    return snapshot.Store(spark, root or f"{shared_folder(spark)}/store")


def registry(labels: str = "none", recursive: bool = True) -> resolvers.Registry:
    """Folders of any file system that Spark reads."""
    known = resolvers.Registry()
    for scheme in ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss"):
        known.register(scheme, lambda spark, base: snapshot.folder(spark, base, recursive, labels))
    return known


def resolve(spark: SparkSession, link: str, root: str | None = None, known: resolvers.Registry | None = None, labels: str = "none") -> tuple[str, DataFrame]:
    """(hash, manifest) of a link: pinned by @sha256:.., indexed anew by @refresh, else the current one."""
    found = known or registry(labels)
    return store(spark, root).resolve(link, lambda base: found.manifest(spark, base))


def samples(spark: SparkSession, link: str, start: int | None = None, end: int | None = None, token: resume.DataToken | None = None, epoch: int = 0, f: transforms.Transform | None = None, readers: dict | None = None, **of) -> tuple[str, DataFrame]:
    """(hash, rows): the manifest with payload and label_id, of a slice of ids or from a token on, transformed."""
    key, rows = resolve(spark, link, **of)
    n = rows.count()
    if token is not None:
        rows = resume.resumed(rows, token, key, epoch, n)
    rows = manifest.sliced(rows, start, end, n)
    read = payloads.with_bytes(rows, readers).withColumn("label_id", manifest.label_id_of(F.col("decode_hint")))
    return key, transforms.applied(read, f) if f else read


def load(spark: SparkSession, link: str, batch: int = 32, by_bytes: tuple[int, int] | None = None, block: int = 65_536, seed: int = 0, epoch: int = 0, rank: int = 0, world: int = 1, profile: str = "balanced", **of) -> DataFrame:
    """Batches (batch_id, sample_ids, offsets, payload, label_ids) of one rank's work ranges in the epoch's order.

    by_bytes: (target, most) bytes of a batch; without it a batch has `batch` samples. Batches are cut within work ranges, and batch_id counts
    them range by range, so in_order(..) gives them as they are to be delivered.
    """
    inflight = control.PROFILES[profile].inflight
    _, rows = samples(spark, link, epoch=epoch, **of)
    mine = ranges.ranked(ranges.blocks(rows, block), seed, epoch, world).filter(F.col("rank") == rank).select("start_id", "position")
    placed = rows.withColumn("start_id", F.col("sample_id") - F.col("sample_id") % block)
    if by_bytes:
        sized = placed.withColumn("byte_length", F.octet_length("payload").cast("long"))
        cut = batching.by_bytes(sized, "start_id", batch, *by_bytes, inflight=inflight)
        numbered = sized.join(cut.select("start_id", "batch_no", "first_id", "last_id"), "start_id").filter(F.col("sample_id").between(F.col("first_id"), F.col("last_id")))
    else:
        numbered = placed.withColumn("batch_no", F.expr(f"(sample_id - start_id) div {batch}"))
    ready = numbered.join(mine, "start_id").withColumn("batch_id", F.col("position") * block + F.col("batch_no"))
    return transforms.batches_within(batching.with_payload(ready), inflight)


def text(spark: SparkSession, link: str, tokenizer, width: int, stride: int | None = None, bos: bool = False, eos: bool = True, truncate: str = "right", policy: str = "error", **of) -> DataFrame:
    """(sample_id, window_no, token_ids, mask)."""
    _, rows = samples(spark, link, **of)
    return _text.rows_of_text(rows.select("sample_id", "payload"), tokenizer, width, stride, bos, eos, truncate, policy)


def audio(spark: SparkSession, link: str, frames: int, rate: int | None = None, policy: str = "error", channels: int = 1, **of) -> DataFrame:
    """(sample_id, samples)."""
    _, rows = samples(spark, link, **of)
    return _audio.frames(rows.select("sample_id", "payload"), frames, rate, policy, channels)


def image(spark: SparkSession, link: str, preset: str | None = None, seed: int = 0, epoch: int = 0, require_labels: bool = True, link_options: dict | None = None, **options) -> DataFrame:
    """(sample_id, label_id, height, width, pixels)."""
    key, rows = samples(spark, link, epoch=epoch, **(link_options or {}))
    return images.pixels(rows, images.preset(preset, **options), fnv1a(key.encode()), seed, epoch, require_labels=require_labels)


def video_clips(spark: SparkSession, link: str, clip: int, stride: int, seed: int = 0, epoch: int = 0, rank: int = 0, world: int = 1, most: int | None = None, policy: str = "native", **of) -> tuple[DataFrame, DataFrame]:
    """(clips of the rank, failures by kind): clips have sample_id, media_uri, stream_id, clip_start, clip_len, fps_policy, clip_id."""
    key, rows = resolve(spark, link, **of)
    hint = F.col("decode_hint")
    known = rows.select(F.col("sample_id").alias("media_id"), F.col("location").alias("media_uri"), media.media_state(hint, clip).alias("state"), manifest.hint_field(hint, "frames").try_cast("long").alias("frames"), manifest.hint_field(hint, "stream_id").try_cast("long").alias("stream_id"))
    good = known.filter("state is null")
    made = media.clips(good, clip, stride)
    if most is not None:
        video.bounded(made, most)
    named = made.join(good.select("media_id", "media_uri", "stream_id"), "media_id")
    ids = manifest.with_dense_ids(named, "media_id", "clip_start")
    told = ids.withColumns({"clip_len": F.lit(clip), "fps_policy": F.lit(policy), "clip_id": media.clip_id(key, F.col("media_id"), F.col("media_uri"), F.col("stream_id"), F.col("clip_start"), clip, stride, policy, seed, epoch)})
    failures = known.filter("state is not null").groupBy("state").agg(F.count("*").alias("n"))
    return told.filter(F.pmod("sample_id", F.lit(world)) == rank).select(*video.CLIP_COLUMNS), failures


def mix(sources: Sequence[DataFrame], weights: Sequence[float], seed: int = 0, epoch: int = 0, exhausted: str = "allow", caps: Sequence[int] | None = None, order: str = "batch_id") -> DataFrame:
    """(tick, source_no, ..): the batches of several sources in the order of a weighted round robin. The sources have the same columns."""
    if len(sources) != len(weights) or not sources:
        raise ValueError("a mix has one source or more, and a weight for each")
    spark = sources[0].sparkSession
    numbered = [manifest.with_dense_ids(s, order, name="pick_no").withColumn("source_no", F.lit(k)) for k, s in enumerate(sources)]
    plan = mixing.mixed(spark, list(weights), [s.count() for s in numbered], seed, epoch, exhausted)
    every = numbered[0]
    for s in numbered[1:]:
        every = every.unionByName(s)
    out = mixing.interleaved(plan, every).drop("pick_no")
    return mixing.within_cap(out, mixing.shared_cap(list(caps))) if caps else out


def stats(batches: DataFrame, raw: bool = False, **known) -> dict | str:
    """Counters of delivered batches (n, bytes): as they are, or in a few lines with what else is known (total, seconds, rss, limit)."""
    seen = control.delivery_stats(batches).first().asDict()
    return seen if raw else control.human_stats(seen | known)
