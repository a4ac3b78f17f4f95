"""Queries over samples' bytes, what they decode to, and how a delivery is steered and resumed; registered with the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.operators import audio, batching, control, images, manifest, media, mixing, packing, payloads, ranges, resume, text, transforms, video
from tidemill.plans.catalog import BLOCK, BLOCKS, CLIPS, EPOCH, GIVEN, MANIFEST, PLAN, RUN, SEED, SIZES, TWO64, _unit, chunk_rows, clip_rows, docs, plan, query, sizes, t
from tidemill.plans.lineage import new_folder

SHARD_MB = 1
PATHS = "(SELECT row_number() OVER (ORDER BY doc_id) - 1 AS sample_id, doc_id, lang, text, octet_length(encode(text))::BIGINT AS byte_length FROM documents)"


def objects(spark, sf_dir):
    """The documents as small files in folders: lang/doc_id.txt would sort by language, so the name begins with the number."""
    return t(spark, sf_dir, "documents").select(F.format_string("%012d/%s.txt", "doc_id", F.col("lang")).alias("path"), F.encode("text", "UTF-8").alias("payload"), "doc_id", "lang")


def packed(spark, sf_dir):
    return packing.pack(objects(spark, sf_dir).select("path", "payload"), new_folder(spark, "pack"), SHARD_MB, "none", empty=True)


@query(f"""WITH RECURSIVE x AS MATERIALIZED (SELECT sample_id, byte_length, 512 + ((byte_length + 511) // 512) * 512 AS entry FROM {PATHS}), f AS (
    SELECT sample_id, byte_length, 0::BIGINT AS shard, 512::BIGINT AS byte_offset, entry AS used FROM x WHERE sample_id = 0
    UNION ALL
    SELECT x.sample_id, x.byte_length, CASE WHEN used + entry > {SHARD_MB << 20} THEN shard + 1 ELSE shard END, CASE WHEN used + entry > {SHARD_MB << 20} THEN 512 ELSE used + 512 END, CASE WHEN used + entry > {SHARD_MB << 20} THEN entry ELSE used + entry END
    FROM f JOIN x ON x.sample_id = f.sample_id + 1)
SELECT sample_id, byte_length, shard, byte_offset FROM f""")
def pack_plan(spark, sf_dir):
    """Where each document's bytes are in which tar shard; a document without characters is a header alone."""
    made = objects(spark, sf_dir).select("path", F.octet_length("payload").alias("byte_length"))
    return packing.planned(made, SHARD_MB << 20, empty=True).select("sample_id", "byte_length", "shard", "byte_offset")


@query(f"SELECT sample_id, byte_length, sha256(text) AS digest FROM {PATHS}")
def payload_digests(spark, sf_dir):
    """Every document packed into tar shards and read back by its byte range."""
    return payloads.with_bytes(packed(spark, sf_dir)).select("sample_id", "byte_length", F.sha2("payload", 256).alias("digest"))


@query(f"SELECT sample_id // 16 AS batch_id, sha256(string_agg(text, '' ORDER BY sample_id)) AS digest, list_prepend(0::BIGINT, list(c ORDER BY sample_id)) AS offsets, list(label ORDER BY sample_id) AS label_ids FROM (SELECT *, dense_rank() OVER (ORDER BY lang) - 1 AS label, sum(byte_length) OVER (PARTITION BY sample_id // 16 ORDER BY sample_id)::BIGINT AS c FROM {PATHS}) GROUP BY 1")
def batch_payload(spark, sf_dir):
    """Batches with their payload, offsets and labels."""
    rows = objects(spark, sf_dir).withColumn("label", F.col("lang"))
    ids = manifest.with_dense_ids(rows.join(manifest.label_ids(rows, "label"), "label"), "doc_id").withColumn("batch_id", F.expr("sample_id div 16"))
    return batching.with_payload(ids).select("batch_id", F.sha2("payload", 256).alias("digest"), "offsets", "label_ids")


@query(f"SELECT sample_id, sha256(substring(h, byte_length - byte_length // 3 + byte_length - byte_length // 3 + 1) || substring(h, 1, 2 * (byte_length // 2))) AS digest FROM (SELECT *, hex(encode(text)) AS h FROM {PATHS}) WHERE byte_length >= 6")
def ranged_bytes(spark, sf_dir):
    """Two ranges of each document, its last third and its first half, fetched and put together in this order."""
    rows = packed(spark, sf_dir).filter("byte_length >= 6")
    two = rows.select(F.col("sample_id").alias("plan_id"), "location", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.expr("byte_offset + byte_length - byte_length div 3").alias("byte_offset"), F.expr("byte_length div 3").alias("byte_length")),
        F.struct(F.lit(1).alias("part"), F.col("byte_offset"), F.expr("byte_length div 2").alias("byte_length")))).alias("r")).select("plan_id", "location", "r.*")
    return payloads.with_ranges(two).select(F.col("plan_id").alias("sample_id"), F.sha2(F.hex("payload"), 256).alias("digest"))


CAP = 64
XORED = f"list_transform(list_transform(list_transform([rng], lambda x: xor(x, (x << 7) % {TWO64})), lambda x: xor(x, x >> 9)), lambda x: xor(x, (x << 8) % {TWO64}))[1]"


@query(f"""WITH RECURSIVE f AS (
    SELECT 0::BIGINT AS step, {SEED}::UHUGEINT AS rng, []::BIGINT[] AS held, NULL::BIGINT AS out_id, n FROM (SELECT count(*) AS n FROM documents)
    UNION ALL
    SELECT step + 1, rng, CASE WHEN gives THEN list_transform(range(1, len(all_held)), lambda k: CASE WHEN k = pick THEN all_held[len(all_held)] ELSE all_held[k] END) ELSE all_held END, CASE WHEN gives THEN all_held[pick] END, n
    FROM (SELECT *, CASE WHEN len(all_held) > 1 THEN (rng % len(all_held)::UHUGEINT)::BIGINT + 1 ELSE 1 END AS pick FROM (
        SELECT step, n, all_held, gives, CASE WHEN gives AND len(all_held) > 1 THEN {XORED} ELSE rng END AS rng FROM (
            SELECT *, len(all_held) > {CAP} OR step >= n AS gives FROM (SELECT *, CASE WHEN step < n THEN list_append(held, step) ELSE held END AS all_held FROM f WHERE step < n OR len(held) > 0)))))
SELECT row_number() OVER (ORDER BY step) - 1 AS sample_id, d.doc_id FROM f JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS at FROM documents) d ON d.at = f.out_id""")
def reservoir_scan(spark, sf_dir):
    """The order in which a scan through a reservoir of 64 gives the documents."""
    return payloads.reservoir(t(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=SEED, cap=CAP).select("sample_id", "doc_id")


@query("SELECT c_custkey, c_name || ' %~é' AS decoded FROM customer")
def percent_decode(spark, sf_dir):
    made = t(spark, sf_dir, "customer").select("c_custkey", manifest.percent_encoded(F.concat("c_name", F.lit(" %~é"))).alias("encoded"))
    return made.select("c_custkey", manifest.percent_decoded(F.col("encoded")).alias("decoded"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN dense_rank() OVER (ORDER BY lang) - 1 END AS label_id FROM documents")
def label_of_hint(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"))
    hints = rows.join(manifest.label_ids(rows, "label"), "label").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("text;label_id=7")).otherwise(manifest.label_hint(F.col("label_id"), F.col("label"))).alias("hint"))
    return hints.select("doc_id", manifest.label_id_of(F.col("hint")).alias("label_id"))


@query("SELECT doc_id, label, dense_rank() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT doc_id, source AS label FROM documents)")
def label_folders(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return manifest.labelled(rows, F.col("path"), "imagefolder").select("doc_id", "label", "label_id")


EXTENSIONS = ["mp4", "WEBM", "avi", "mpeg", "txt", "mov"]


@query(f"SELECT p_partkey, CASE WHEN e <> 'txt' THEN 'video;frames=' || greatest(1, p_size * 10007 // 50000) || ';stream_id=0;codec=' || CASE lower(e) WHEN 'webm' THEN 'vp9' WHEN 'avi' THEN 'mpeg4' WHEN 'mpeg' THEN 'mpeg4' ELSE 'h264' END END AS hint FROM (SELECT *, ({EXTENSIONS})[p_partkey % 6 + 1] AS e FROM part)")
def video_hints(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t(spark, sf_dir, "part").select("p_partkey", manifest.video_hint(F.concat(F.lit("a.b/c."), ends), F.col("p_size").cast("long") * 10007).alias("hint"))


WORDS = "(SELECT w, row_number() OVER (ORDER BY w) AS id FROM (SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS w FROM benchmark) WHERE w <> '')"
IDS = f"(SELECT conv_id, turn, list_append(list_prepend(1000001::BIGINT, coalesce(list(id ORDER BY k) FILTER (w <> ''), [])), 1000002::BIGINT) AS ids FROM (SELECT conv_id, turn, k, x.w, coalesce(d.id, 0) AS id FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS w, generate_subscripts(string_split_regex(text, '[ \\t\\n\\r\\f]+'), 1) AS k FROM conversations) x LEFT JOIN {WORDS} d ON d.w = x.w) GROUP BY conv_id, turn)"


def vocabulary(spark, sf_dir) -> text.Words:
    """The words of the benchmark's items, numbered in order; a vocabulary is what a worker holds, so it is of a bounded table."""
    words = t(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[ \\t\\n\\r\\f]+")).alias("w")).filter("w <> ''").distinct().orderBy("w").collect()
    return text.Words({"[UNK]": 0, "<s>": 1_000_001, "</s>": 1_000_002} | {r[0]: k + 1 for k, r in enumerate(words)})


@query(f"SELECT conv_id, turn, ids FROM {IDS}")
def word_tokens(spark, sf_dir):
    """Each turn as the ids of a vocabulary, between the ids of its begin and end tokens."""
    known = vocabulary(spark, sf_dir)
    ids = text.tokenised(t(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), known.encode)
    return ids.select("conv_id", "turn", text.bounded(F.col("ids"), text.special_id(known, "bos"), text.special_id(known, "eos")).alias("ids"))


@query(f"""WITH w AS (SELECT conv_id, turn, ids, unnest(range(0, (greatest(0, least(ceil(len(ids) / 24.0)::BIGINT - 1, ceil(greatest(len(ids) - 32, 0) / 24.0)::BIGINT)) + 1))) AS k FROM {IDS})
SELECT conv_id, turn, k::INT AS window_no, list_concat(ids[k * 24 + 1 : k * 24 + 32], list_transform(range(0, 32 - len(ids[k * 24 + 1 : k * 24 + 32])), lambda x: 1000002::BIGINT)) AS token_ids, list_transform(range(0, 32), lambda x: CASE WHEN x < len(ids[k * 24 + 1 : k * 24 + 32]) THEN 1 ELSE 0 END) AS mask FROM w""")
def token_windows(spark, sf_dir):
    """From payloads to windows: decoded, tokenised, bounded, padded with the end's id."""
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("payload"))
    return text.rows_of_text(rows, vocabulary(spark, sf_dir), 32, 24, bos=True)


@query("SELECT doc_id, length(text)::INT AS n FROM documents WHERE doc_id % 5 > 1")
def utf8_skipped(spark, sf_dir):
    """The documents without those whose bytes aren't UTF-8."""
    tail = F.when(F.col("doc_id") % 5 == 0, F.lit(b"\xc3")).when(F.col("doc_id") % 5 == 1, F.lit(b"\xff\xfe")).otherwise(F.lit(b""))
    raw = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.encode("text", "UTF-8"), tail).alias("payload"))
    return text.decoded(raw, policy="skip").select("doc_id", F.length("text").alias("n"))


def wav_rows(spark, sf_dir):
    """Each vector as a WAV file of 16 bits at 16 kHz."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([audio.wav_bytes(np.rint(np.array(x, np.float64) * 1000).astype(np.int16), 16_000) for x in b.column(1).to_pylist()], pa.binary())], names=["vec_id", "payload"])

    return t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).mapInArrow(made, "vec_id long, payload binary")


@query("SELECT vec_id, 100::INT AS n, list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 1000)::INT))::BIGINT AS total, (embedding[1]::DOUBLE * 1000)::INT::BIGINT AS head FROM embeddings")
def audio_frames(spark, sf_dir):
    """WAV files decoded and padded to 100 frames."""
    out = audio.frames(wav_rows(spark, sf_dir), 100, 16_000)
    whole = lambda x: F.rint(x.cast("double") * 32768).cast("long")
    return out.select("vec_id", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + whole(x)).alias("total"), whole(F.get("samples", F.lit(0))).alias("head"))


PIXEL = f"(SELECT vec_id, list_transform(range(0, 27), lambda k: floor((embedding[((top + (k % 9) // 3) * 4 + lft + CASE WHEN flip THEN 2 - k % 3 ELSE k % 3 END) * 3 + k // 9 + 1]::DOUBLE + 1) * 127)::BIGINT) AS px FROM (SELECT vec_id, embedding, least(floor(2::FLOAT * {_unit(1)}), 1)::INT AS top, least(floor(2::FLOAT * {_unit(2)}), 1)::INT AS lft, {_unit(3)} < 0.5::FLOAT AS flip FROM (SELECT *, vec_id AS sample_id FROM embeddings)))"


@query(f"SELECT vec_id AS sample_id, 3::INT AS height, 3::INT AS width, px FROM {PIXEL}")
def image_pixels(spark, sf_dir):
    """Images of 4 x 4 pixels, decoded, cropped to 3 x 3 and flipped by each one's own choices, channel by channel."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([images.ppm_bytes(np.floor((np.array(x[:48], np.float64) + 1) * 127).reshape(4, 4, 3)) for x in b.column(1).to_pylist()], pa.binary())], names=["sample_id", "payload"])

    rows = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("e")).mapInArrow(made, "sample_id long, payload binary")
    out = images.pixels(rows, images.Options(resize=(4, 4), crop=3, flip=0.5), RUN, SEED, EPOCH)
    return out.select("sample_id", "height", "width", F.transform("pixels", lambda x: F.rint(x.cast("double") * 255).cast("long")).alias("px"))


@query("SELECT o_orderkey, o_orderkey % 400 * 1000 // (o_orderkey % 30 + 1) AS start_ms, greatest(o_orderkey % 400 * 1000 // (o_orderkey % 30 + 1) - o_orderkey % 9000, 0) AS seek_ms FROM orders")
def clip_times(spark, sf_dir):
    k = F.col("o_orderkey")
    at = video.frame_ms(k % 400, k % 30 + 1)
    return t(spark, sf_dir, "orders").select("o_orderkey", at.alias("start_ms"), video.seek_ms(at, k % 9000).alias("seek_ms"))


SAID = ["x: No such file or directory", "moov atom not found; decoder", "Stream specifier 'v:0' matches no streams", "Unknown codec id 3", "End of file", "killed"]
MEANT = ["io_read_failed", "corrupt_media", "missing_stream", "unsupported_codec", "short_media", "decode_failed"]


@query(f"SELECT o_orderkey, ({MEANT})[o_orderkey % 6 + 1] AS failure FROM orders")
def decode_failures(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return t(spark, sf_dir, "orders").select("o_orderkey", video.failure_class(said).alias("failure"))


@query("SELECT s_suppkey AS sample_id, k AS chunk_index, k * 1000 AS start_ms, k * 10000 + (s_suppkey + k * k) % 7 * 100 AS start_byte FROM supplier, (SELECT range AS k FROM range(0, 8)) WHERE s_suppkey % 9 <> 0 AND s_suppkey % 4 <> 3 AND s_suppkey % 10 <> 7")
def hint_sidecars(spark, sf_dir):
    """Range sidecars read from hints; those at fault, or with an entry that is none, are left out whole."""
    part = F.concat_ws(",", *(F.col(c).cast("string") for c in ("chunk_index", "start_ms", "end_ms", "start_byte", "end_byte", "keyframe")))
    listed = chunk_rows(spark, sf_dir).groupBy("media_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", part.alias("p")))), lambda x: x["p"]), "|").alias("chunks"))
    rows = listed.select(F.col("media_id").alias("sample_id"), F.concat(F.lit("f://"), F.col("media_id").cast("string")).alias("location"), F.concat(F.lit("video;stream_id=0;codec=h264;chunks="), "chunks", F.when(F.col("media_id") % 10 == 7, "|1,2,x").otherwise("")).alias("decode_hint"))
    return video.ranges_of_hints(rows)[0].select("sample_id", "chunk_index", "start_ms", "start_byte")


@query(f"SELECT sample_id, concat_ws(chr(9), sample_id, 'f://' || media_id, 0, clip_start, 4, 'native', sha256(concat_ws('|', 'm', media_id, 'f://' || media_id, 0, clip_start, 4, 3, 'native', {SEED}, {EPOCH}))) AS line FROM {CLIPS}")
def clip_text(spark, sf_dir):
    """The clip table's canonical lines."""
    uri = F.concat(F.lit("f://"), F.col("media_id").cast("string"))
    rows = clip_rows(spark, sf_dir).select("sample_id", uri.alias("media_uri"), F.lit(0).alias("stream_id"), "clip_start", F.lit(4).alias("clip_len"), F.lit("native").alias("fps_policy"), media.clip_id("m", F.col("media_id"), uri, F.lit(0), F.col("clip_start"), 4, 3, "native", SEED, EPOCH).alias("clip_id"))
    return video.text_of(rows, video.CLIP_COLUMNS)


QUEUE = "SELECT o_orderkey AS start_id, o_orderkey + 10 AS end_id, CAST(o_orderkey % 4 AS INT) AS rank, o_orderkey * 7919 % 1000003 AS position, o_orderkey % 6 = 0 AS requeued FROM orders"


def queue(spark, sf_dir):
    t(spark, sf_dir, "orders").createOrReplaceTempView("tidemill_orders")
    return spark.sql(QUEUE.replace("FROM orders", "FROM tidemill_orders"))


@query(f"SELECT r AS rank, start_id, end_id, row_number() OVER (PARTITION BY r ORDER BY position, start_id) - 1 AS turn FROM (SELECT *, CASE WHEN NOT requeued THEN rank END AS r FROM ({QUEUE}))")
def lease_pop_order(spark, sf_dir):
    return ranges.pop_order(queue(spark, sf_dir))


@query("SELECT user_id % 40 AS node, max(event_id) AS last_ms FROM events WHERE user_id % 40 <> 3 OR event_id < 500 GROUP BY 1 HAVING (SELECT max(event_id) FROM events) - max(event_id) > 300")
def dead_nodes(spark, sf_dir):
    """Nodes whose last heartbeat is more than 300 before the last of all."""
    events = t(spark, sf_dir, "events")
    beats = events.filter("user_id % 40 <> 3 or event_id < 500").select((F.col("user_id") % 40).alias("node"), F.col("event_id").alias("seen_ms"))
    return ranges.dead_nodes(beats, events.agg(F.max("event_id")).first()[0], 300)


@query(f"SELECT CASE WHEN start_id = 64 THEN 100 ELSE start_id END AS start_id, end_id FROM {BLOCKS} WHERE start_id <> 0")
def lease_resume(spark, sf_dir):
    """What is left where a distributed delivery stopped with the first block done and the second at 100."""
    made = ranges.blocks(t(spark, sf_dir, "documents"), BLOCK)
    token = resume.LeaseToken("m", EPOCH, [(64, 100, 128)], [(0, 64)])
    return resume.resumed_leases(made, [token, resume.LeaseToken.decode(token.encode())], "m", EPOCH)


@query(f"SELECT sample_id, location FROM {MANIFEST} WHERE sample_id >= 77")
def local_resume(spark, sf_dir):
    rows = docs(spark, sf_dir)
    n = rows.count()
    token = resume.DataToken.decode(resume.DataToken("m", EPOCH, 77, n).encode())
    return resume.resumed(rows, token, "m", EPOCH, n).select("sample_id", "location")


@query(f"SELECT * FROM {CLIPS} WHERE sample_id % 4 = 1 AND sample_id // 4 >= 10")
def video_resume(spark, sf_dir):
    """Rank 1 of 4 goes on at its tenth clip."""
    rows = clip_rows(spark, sf_dir)
    token = resume.VideoToken("m", SEED, EPOCH, 4, 3, 8, 10, rows.count(), 1, 4)
    return resume.resumed_clips(rows, token, manifest="m", seed=SEED, epoch=EPOCH, rank=1, world=4).select("sample_id", "media_id", "clip_start")


@query(PLAN + f"SELECT * FROM {GIVEN} WHERE tick >= 123")
def mix_resume(spark, sf_dir):
    token = resume.MixToken(SEED, EPOCH, 123, ["a", "b", "c", "d"], [60, 40, 20, 3])
    return resume.resumed_mix(plan(spark, sf_dir), token, SEED, EPOCH, ["a", "b", "c", "d"])[0]


@query(PLAN + f"SELECT tick FROM {GIVEN} WHERE tick > 0 AND tick % 64 = 0")
def mix_snapshots(spark, sf_dir):
    return mixing.snapshots(plan(spark, sf_dir))


@query(f"SELECT count(*) AS batches, sum(n)::BIGINT AS samples, sum(bytes)::BIGINT AS bytes, min(bytes) AS least, max(bytes) AS most, sum(bytes)::BIGINT // count(*) AS mean FROM (SELECT batch_id, bytes, 8 AS n FROM {SIZES})")
def delivery_stats(spark, sf_dir):
    return control.delivery_stats(sizes(spark, sf_dir).select("batch_id", "bytes", F.lit(8).alias("n")))


@query("SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.2fGiB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.2fMiB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.2fKiB', b / 1024.0) ELSE b || 'B' END AS size, CASE WHEN o_orderkey % 100 >= 85 THEN 'HIGH' WHEN o_orderkey % 100 >= 60 THEN 'WARM' ELSE 'STABLE' END AS pressed FROM (SELECT *, o_orderkey * o_orderkey * (o_orderkey % 5) * 64 AS b FROM orders)")
def readable_sizes(spark, sf_dir):
    k = F.col("o_orderkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", control.readable_bytes(k * k * (k % 5) * 64).alias("size"), control.pressure_class((k % 100) / F.lit(100.0)).alias("pressed"))


@query("SELECT node, count(*) AS reports, sum(inflight)::BIGINT AS inflight, max(seen) AS last_seen, max(seen) < (SELECT max(event_id) FROM events) - 20 AS stale, coalesce(max(moved), -1) < (SELECT max(event_id) FROM events) - 400 AS stalled FROM (SELECT user_id % 16 AS node, event_id AS seen, event_id % 100 AS inflight, CASE WHEN event_type = 'click' AND user_id % 16 <> 5 THEN event_id END AS moved FROM events) GROUP BY node")
def cluster_stalled(spark, sf_dir):
    made = t(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("node"), F.col("event_id").alias("seen"), (F.col("event_id") % 100).alias("inflight"), F.when((F.col("event_type") == "click") & (F.col("user_id") % 16 != 5), F.col("event_id")).alias("moved"))
    return control.cluster_summary(made, stale=20, stalled=400)


@query("SELECT doc_id, sha256(text || '|' || text || 'end') AS digest FROM documents")
def transform_decorated(spark, sf_dir):
    """The decorator's way, with literals between and behind."""
    rows = t(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"))
    return transforms.applied(rows, joined).select("doc_id", F.sha2("payload", 256).alias("digest"))


@transforms.transform
def joined(sample):
    return sample + b"|" + sample + b"end"

