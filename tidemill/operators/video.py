"""Video around the decoder: clip tables, range sidecars, what a clip decodes to, batches of clips, limits."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import manifest, media

CLIPS_HEADER, RANGES_HEADER = "video_schema_version=1", "video_range_schema_version=1"
CLIP_COLUMNS = ["sample_id", "media_uri", "stream_id", "clip_start", "clip_len", "fps_policy", "clip_id"]
RANGE_COLUMNS = ["sample_id", "media_uri", "stream_id", "codec", "schema_version", "chunk_index", "start_ms", "end_ms", "start_byte", "end_byte", "keyframe"]
SIDECAR = ["sample_id", "media_uri", "stream_id", "codec", "schema_version"]
NUMBERS = {"sample_id", "stream_id", "clip_start", "clip_len", "schema_version", "chunk_index", "start_ms", "end_ms", "start_byte", "end_byte", "keyframe"}
#: What a decoder says, and what it means; the first that is found counts.
FAILURES = [
    ("io_read_failed", ["no such file or directory"]), ("corrupt_media", ["error reading header", "invalid data found when processing input", "moov atom not found"]),
    ("missing_stream", ["does not contain any stream", "matches no streams", "stream specifier"]), ("unsupported_codec", ["decoder", "unknown codec", "unsupported codec"]), ("short_media", ["end of file"]),
]


def bounded(clips: DataFrame, most: int) -> DataFrame:
    """clips, if there are no more than `most`; else an error. They are counted before any is made."""
    n = clips.count()
    if n > most:
        raise ValueError(f"{n} clips, but {most} may be held")
    return clips


def text_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(sample_id, line) of the canonical text; the header is the first line of the file, not of the table."""
    return rows.select("sample_id", manifest.canonical_line(*columns).alias("line"))


def _read(spark: SparkSession, path: str, header: str, columns: list[str]) -> DataFrame:
    lines = spark.read.text(path)
    first = lines.filter("trim(value) <> ''").first()
    if first is None or first[0] != header:
        raise ValueError(f"{path} doesn't begin with {header}")
    p = F.split("value", "\t")
    wrong = F.raise_error(F.concat(F.lit("a line with a wrong number of columns: "), "value"))
    parts = lines.filter(f"value <> '' and value <> '{header}'").select(F.when(F.size(p) == len(columns), p).otherwise(wrong).alias("p"))
    typed = lambda k, c: (F.get("p", F.lit(k)).cast("long") if c in NUMBERS else F.get("p", F.lit(k))).alias(c)
    return parts.select(*(typed(k, c) for k, c in enumerate(columns)))


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """The clips of a text table; ids are 0 .. n-1, each once."""
    rows = _read(spark, path, CLIPS_HEADER, CLIP_COLUMNS)
    if not manifest.gaps(rows).first()["dense"]:
        raise ValueError("the ids of clips are 0 .. n-1, each once")
    return rows


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a range sidecar; one that is at fault is an error (see checked_ranges)."""
    rows = _read(spark, path, RANGES_HEADER, RANGE_COLUMNS)
    flags = rows.filter("keyframe not in (0, 1)").limit(1).count()
    if flags:
        raise ValueError("keyframe is 0 or 1")
    return checked_ranges(rows)


def checked_ranges(chunks: DataFrame) -> DataFrame:
    """chunks, if every sidecar (by all five of its keys) has spans over 0 that increase and don't overlap, and a keyframe; else an error."""
    bad = media.faulty_chunks(chunks, *SIDECAR).filter("not valid").limit(3).collect()
    if bad:
        raise ValueError(f"sidecars at fault: {[(r['media_uri'], r['stream_id']) for r in bad]}")
    return chunks


def ranges_of_hints(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected) of manifest rows whose hint lists chunks as index,start_ms,end_ms,start_byte,end_byte,keyframe parted by |.

    What isn't six numbers, or makes a sidecar at fault, rejects the whole sidecar, which is told and otherwise ignored.
    """
    listed = manifest.hint_field(F.col("decode_hint"), "chunks")
    base = rows.select("sample_id", F.col("location").alias("media_uri"), F.coalesce(manifest.hint_field(F.col("decode_hint"), "stream_id").try_cast("long"), F.lit(0)).alias("stream_id"), F.coalesce(manifest.hint_field(F.col("decode_hint"), "codec"), F.lit("unknown")).alias("codec"), F.coalesce(manifest.hint_field(F.col("decode_hint"), "schema").try_cast("long"), F.lit(1)).alias("schema_version"), F.filter(F.split(listed, r"\|"), lambda x: F.trim(x) != "").alias("parts")).filter("size(parts) > 0")
    c = F.split(F.col("part"), ",")
    number = lambda k: F.trim(F.get(c, F.lit(k))).try_cast("long")
    each = base.select(*SIDECAR, F.explode("parts").alias("part")).select(*SIDECAR, F.when(F.size(c) == 6, number(0)).alias("chunk_index"), number(1).alias("start_ms"), number(2).alias("end_ms"), number(3).alias("start_byte"), number(4).alias("end_byte"), F.when(manifest.truthy(F.get(c, F.lit(5))), 1).otherwise(0).cast("long").alias("keyframe"))
    whole = each.withColumn("holes", F.expr("chunk_index is null or start_ms is null or end_ms is null or start_byte is null or end_byte is null").cast("int"))
    faults = media.faulty_chunks(whole.filter("holes = 0"), *SIDECAR).filter("not valid").select(*SIDECAR).unionByName(whole.filter("holes = 1").select(*SIDECAR)).distinct()
    return each.join(faults, SIDECAR, "left_anti"), faults


def decode_contract(clip: int, bytes_per_clip: int) -> dict[str, int]:
    """What a clip decodes to: frames of a square of whole pixels of three bytes, as many as fit into its bytes; strides of frames, rows, pixels and channels."""
    if clip <= 0:
        raise ValueError("a clip has a frame or more")
    side = max(1, isqrt(max(1, max(1, bytes_per_clip // clip) // 3)))
    return {"frames": clip, "height": side, "width": side, "channels": 3, "stride_t": 3 * side * side, "stride_h": 3 * side, "stride_w": 3, "stride_c": 1, "clip_bytes": 3 * side * side * clip}


def frame_ms(frame: Column, fps: Column) -> Column:
    """The millisecond at which a frame begins."""
    return F.floor(frame * F.lit(1000) / fps).cast("long")


def seek_ms(start_ms: Column, anchor_ms: Column) -> Column:
    """How far a clip begins behind the keyframe that was fetched with it."""
    return F.greatest(start_ms - anchor_ms, F.lit(0))


def failure_class(said: Column) -> Column:
    low = F.lower(said)
    out = None
    for name, texts in FAILURES:
        hit = low.contains(texts[0])
        for x in texts[1:]:
            hit = hit | low.contains(x)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("decode_failed")


def exact_frames(payload: bytes, contract: dict[str, int]) -> bytes:
    """Exactly a clip's bytes: what is over is cut, too few are an error."""
    if len(payload) < contract["clip_bytes"]:
        raise ValueError(f"short_media: {len(payload)} bytes of {contract['clip_bytes']}")
    return payload[: contract["clip_bytes"]]


def decoded_clips(rows: DataFrame, decoders: list, contract: dict[str, int]) -> DataFrame:
    """(clip_id, payload, decoder) from (clip_id, payload): by the first of the decoders (functions bytes -> bytes, the preferred first) that doesn't fail, whose place is told; if all fail, an error."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for clip, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                said = []
                for k, decode in enumerate(decoders):
                    try:
                        out = exact_frames(decode(data), contract)
                        break
                    except (OSError, ValueError) as e:
                        said.append(str(e))
                else:
                    raise ValueError(f"clip {clip}: {'; '.join(said)}")
                yield pa.RecordBatch.from_arrays([pa.array([clip]), pa.array([out], pa.binary()), pa.array([k], pa.int32())], names=["clip_id", "payload", "decoder"])

    kind = rows.schema["clip_id"].dataType.simpleString()
    return rows.select("clip_id", "payload").mapInArrow(run, f"clip_id {kind}, payload binary, decoder int")


def index_hash(clips: DataFrame) -> str:
    """The hash of a clip table's text: the same for every replay of the same snapshot, seed and epoch."""
    renamed = clips.select("sample_id", F.col("media_uri").alias("location"), F.col("clip_start").alias("byte_offset"), F.col("clip_len").alias("byte_length"), F.concat_ws(";", F.col("stream_id").cast("string"), "fps_policy", "clip_id").alias("decode_hint"))
    return manifest.content_hash(renamed)


def next_inflight(now: int, rss: float, inflight: float, least: int, most: int, gpu: float | None = None, wants_gpu: bool = False, calm: int = 0) -> tuple[int, str]:
    """(bytes, why): the next limit of what is in flight, from how full memory, limit and (if it decodes) the graphics card are; calm: good readings of the card in a row."""
    most, new, why = max(most, least), float(now), "none"
    if wants_gpu and gpu is None:
        new, why = now * 0.75, "no_gpu_reading"
    elif gpu is not None and gpu >= 0.97:
        new, why = least, "gpu_full"
    elif gpu is not None and gpu >= 0.92:
        new, why = now * 0.85, "gpu_high"
    elif rss > 0.92:
        new, why = now * 0.85, "memory_high"
    elif max(rss, inflight, gpu or 0.0) < 0.60 and (not wants_gpu or calm >= 3):
        new, why = now * 1.05, "calm"
    return min(max(int(new + 0.5), least), most), why
