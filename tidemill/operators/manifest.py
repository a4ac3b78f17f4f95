"""Manifests: one row a sample, with dense ids, checks, canonical text and content hash."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.wrap64 import let
from tidemill.plans.lineage import stored

INDEX_BITS = 33  # of monotonically_increasing_id, for the row within its partition
HEADER = "schema_version=0\n"


def with_dense_ids(rows: DataFrame, *order: str, name: str = "sample_id") -> DataFrame:
    """rows with ids 0 .. N-1 in the given order; one range shuffle, then an offset for each partition: no single-task window.

    Only the partitions' sizes reach the driver. The sorted rows are stored first, for two jobs must see the same partitions.
    """
    spark = rows.sparkSession
    ordered = stored(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order))
    placed = ordered.withColumn("_at", F.monotonically_increasing_id())
    sizes = placed.groupBy(F.shiftright("_at", INDEX_BITS).alias("p")).count().orderBy("p").collect()
    starts, total = {}, 0
    for r in sizes:
        starts[r[0]] = total
        total += r[1]
    if not starts:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_at")
    offsets = F.array(*(F.lit(starts.get(p, 0)).cast("long") for p in range(max(starts) + 1)))
    first = F.get(offsets, F.shiftright("_at", INDEX_BITS).cast("int"))
    return placed.withColumn(name, first + F.col("_at").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))).drop("_at")


def of_documents(docs: DataFrame) -> DataFrame:
    """The documents as a manifest: sample_id, location, byte_offset, byte_length, decode_hint, and lang and source."""
    narrow = docs.select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("byte_length"))
    ids = with_dense_ids(narrow, "doc_id")
    return ids.select("sample_id", F.concat_ws("/", F.lit("doc:/"), "source", F.col("doc_id").cast("string")).alias("location"), F.lit(None).cast("long").alias("byte_offset"), "byte_length", F.concat(F.lit("text;lang="), "lang").alias("decode_hint"), "doc_id", "lang", "source")


def error_kind(location: Column, offset: Column, length: Column) -> Column:
    """Null for a good record, else the first thing that is wrong with it."""
    return F.when(location.isNull() | (F.trim(location) == ""), "blank_location").when(offset.isNull() != length.isNull(), "partial_range").when(length <= 0, "empty_range")


def checked(rows: DataFrame) -> DataFrame:
    """rows, if every record is good (see error_kind) and the ids are 0 .. n-1, each once; else an error."""
    bad = rows.select("sample_id", error_kind(F.col("location"), F.col("byte_offset"), F.col("byte_length")).alias("error")).filter("error is not null").limit(3).collect()
    if bad:
        raise ValueError(f"records that aren't good: {[tuple(r) for r in bad]}")
    seen = gaps(rows).first()
    if not seen["dense"]:
        raise ValueError(f"ids are 0 .. n-1, each once: {seen['n']} from {seen['least']} to {seen['greatest']}, {seen['n_distinct']} different")
    return rows


def gaps(rows: DataFrame, name: str = "sample_id") -> DataFrame:
    """(n, least, greatest, n_distinct, dense): dense says that the ids are 0 .. n-1, each once. No sort, no window."""
    seen = rows.agg(F.count("*").alias("n"), F.min(name).alias("least"), F.max(name).alias("greatest"), F.countDistinct(name).alias("n_distinct"))
    return seen.withColumn("dense", (F.col("n") == F.col("n_distinct")) & (F.coalesce("least", F.lit(0)) == 0) & (F.coalesce(F.col("greatest") + 1, F.lit(0)) == F.col("n")))


def sliced(rows: DataFrame, start: int | None, end: int | None, total: int) -> DataFrame:
    """Rows with start <= sample_id < end; the two come together and within 0 .. total. Over a stored snapshot the filter reaches the Parquet scan."""
    if (start is None) != (end is None):
        raise ValueError("start and end come together")
    if start is None:
        return rows
    if not 0 <= start <= end <= total:
        raise ValueError(f"not a range within 0 .. {total}: {start} .. {end}")
    return rows.filter((F.col("sample_id") >= start) & (F.col("sample_id") < end))


def canonical_line(*columns: str) -> Column:
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or ("sample_id", "location", "byte_offset", "byte_length", "decode_hint")))


def content_hash(manifest: DataFrame) -> str:
    """SHA-256 of the canonical text. SHA-256 is sequential, so one task reads the sorted lines as they stream by; the driver gets the digest alone."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha256(HEADER.encode())
        for b in batches:
            if b.num_rows:
                h.update(("\n".join(b.column(0).to_pylist()) + "\n").encode())
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["hash"])

    return manifest.orderBy("sample_id").select(canonical_line().alias("line")).coalesce(1).mapInArrow(digest, "hash string").first()[0]


def hint_fields(hint: Column) -> Column:
    """The k=v parts after the first segment as a map; the last of equal keys wins. For a few known keys `hint_field` is cheaper."""
    parts = F.filter(F.split(hint, ";"), lambda p, i: (i > 0) & p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    last = let(F.struct(pairs.alias("p"), F.reverse(pairs["k"]).alias("back")), lambda x: F.filter(x["p"], lambda y, i: i == F.size(x["p"]) - F.array_position(x["back"], y["k"])))
    return F.map_from_entries(last)


def hint_field(hint: Column, key: str) -> Column:
    """The last value of a key among the k=v parts after the first segment, null where there is none: one match, no map."""
    return F.trim(F.get(F.regexp_extract_all(hint, F.lit(rf"^[^;]*;(?:.*;)?\s*{re.escape(key)}\s*=([^;]*)"), F.lit(1)), F.lit(0)))


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("1", "true", "yes", "on")


def scheme(location: Column) -> Column:
    found = F.lower(F.regexp_extract(location, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when(found == "", "file").otherwise(found)


def percent_encoded(text: Column) -> Column:
    """UTF-8 bytes outside A-Z a-z 0-9 - _ . ~ as %XX, in expressions only."""
    spaced = F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "%$1")
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~":
        spaced = F.replace(spaced, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return spaced


def percent_decoded(text: Column) -> Column:
    """The text of %XX and plain characters; null where a % has no two hexadecimal digits after it, or the bytes aren't UTF-8."""
    parts = F.split(text, "%")
    raw = F.aggregate(F.slice(parts, 2, F.size(parts)), F.encode(F.get(parts, F.lit(0)), "UTF-8"), lambda a, p: F.concat(a, F.unhex(F.substring(p, 1, 2)), F.encode(F.substr(p, F.lit(3)), "UTF-8")))
    bad = F.regexp_like(text, F.lit("%(?![0-9A-Fa-f]{2})"))
    return F.when(~bad, F.try_validate_utf8(raw.cast("string")))


def label_of(path: Column) -> Column:
    """The first folder below the prefix; null where there is none."""
    first = F.trim(F.substring_index(path, "/", 1))
    return F.when(path.contains("/") & (first != ""), first)


def label_ids(rows: DataFrame, label: str) -> DataFrame:
    """(label, label_id): ids are ranks among the distinct labels, which are few; the window runs over those alone."""
    distinct = rows.select(F.col(label).alias("label")).filter("label is not null").distinct()
    return with_dense_ids(distinct, "label", name="label_id").select("label", "label_id")


LABEL_MODES = ("none", "imagefolder", "auto")
LABEL_PREFIX = "vision:folder;"


def labelled(rows: DataFrame, path: Column, mode: str = "auto") -> DataFrame:
    """rows with label and label_id: none gives nulls; imagefolder needs a label for each row; auto labels all rows if each has one and there are two or more."""
    if mode not in LABEL_MODES:
        raise ValueError(f"a label mode is one of {', '.join(LABEL_MODES)}, not {mode!r}")
    named = rows.withColumn("label", label_of(path) if mode != "none" else F.lit(None).cast("string"))
    if mode != "none":
        seen = named.agg(F.count("*").alias("n"), F.count("label").alias("has"), F.countDistinct("label").alias("k")).first()
        if mode == "imagefolder" and seen["n"] != seen["has"]:
            raise ValueError(f"{seen['n'] - seen['has']} of {seen['n']} paths have no folder to be their label")
        if mode == "auto" and (seen["n"] != seen["has"] or seen["k"] < 2):
            named = named.withColumn("label", F.lit(None).cast("string"))
    return named.join(label_ids(named, "label"), "label", "left").select(*rows.columns, "label", "label_id")


def label_hint(label_id: Column, label: Column) -> Column:
    return F.when(label_id.isNotNull(), F.concat(F.lit(f"{LABEL_PREFIX}label_id="), label_id.cast("string"), F.lit(";label="), percent_encoded(label)))


def label_id_of(hint: Column) -> Column:
    """The label_id that a hint of this kind has; null for other hints, an error where it has none or no number."""
    told = F.get(F.regexp_extract_all(hint, F.lit(rf"^{LABEL_PREFIX}(?:[^;]*;)*?\s*label_id\s*=([^;]*)"), F.lit(1)), F.lit(0))
    number = F.when(F.regexp_like(F.trim(told), F.lit("^[0-9]+$")), F.trim(told)).cast("long")
    return F.when(hint.startswith(LABEL_PREFIX), F.when(number.isNull(), F.raise_error(F.concat(F.lit("a label hint without a label_id: "), hint))).otherwise(number))


def all_or_none(rows: DataFrame, by: str, label: str) -> DataFrame:
    """rows, with an error for a batch in which some rows have a label and some don't."""
    w = Window.partitionBy(by)
    mixed = (F.count(label).over(w) > 0) & (F.count(label).over(w) < F.count("*").over(w))
    checked = F.when(mixed, F.raise_error(F.concat(F.lit("some samples of a batch have no label: "), F.col(by).cast("string"))).cast("string"))
    return rows.withColumn("_bad", checked).filter("_bad is null").drop("_bad")


def strictly_increasing(rows: DataFrame, key: str) -> DataFrame:
    """rows sorted by key, with an error where a key is there twice: what an external sort checks of its merged runs."""
    twice = rows.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} is there {twice[0][1]} times: {twice[0][0]}")
    return rows.orderBy(key)


def jump(rows: DataFrame, sample_id: int, around: int = 0) -> DataFrame:
    """The row of an id, with `around` rows before and after it."""
    return rows.filter(F.col("sample_id").between(sample_id - around, sample_id + around))


VIDEO_CODECS = {"avi": "mpeg4", "m4v": "h264", "mkv": "h264", "mov": "h264", "mp4": "h264", "mpeg": "mpeg4", "mpg": "mpeg4", "webm": "vp9"}
CODECS_READ = ["av1", "h263", "h264", "hevc", "mjpeg", "mpeg4", "vp9"]
FRAME_BYTES = 50_000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def video_hint(path: Column, length: Column, codec: Column | None = None, frame_bytes: int = FRAME_BYTES) -> Column:
    """The hint of a video known by its extension alone: frames by its length, the codec usual for it; null for other files."""
    table = F.create_map(*(F.lit(x) for kv in VIDEO_CODECS.items() for x in kv))
    named = F.lower(codec) if codec is not None else F.try_element_at(table, extension(path))
    known = F.when(named.isin(CODECS_READ), named).otherwise("unsupported")
    frames = F.greatest(F.lit(1), F.floor(F.greatest(length, F.lit(1)) / F.lit(frame_bytes)))
    return F.when(extension(path).isin(list(VIDEO_CODECS)), F.concat(F.lit("video;frames="), frames.cast("string"), F.lit(";stream_id=0;codec="), known))


def found_in(query: str, *columns: Column) -> Column:
    """Case-insensitive substring in any column; an empty query finds all."""
    hits = [F.coalesce(F.lower(c).contains(query.lower()), F.lit(False)) for c in columns]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.lit(True) if not query else out
