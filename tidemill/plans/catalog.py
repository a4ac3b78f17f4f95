"""The engine's own queries and their SQL: each key has a function of (spark, sf_dir) and, where SQL can say it, the same in DuckDB's words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import wrap64
from tidemill.operators import batching, manifest, media, mixing, ranges, transforms
from tidemill.plans.lineage import new_folder
from tidemill.sources import snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BLOCK, SEED, EPOCH, WORLD = 64, 17, 3, 2
ROWS, TARGET, MOST = 16, 40_000, 4_000_000
TWO64 = "18446744073709551616::UHUGEINT"
MANIFEST = "(SELECT row_number() OVER (ORDER BY doc_id) - 1 AS sample_id, 'doc://' || source || '/' || doc_id AS location, NULL::BIGINT AS byte_offset, octet_length(encode(text))::BIGINT AS byte_length, 'text;lang=' || lang AS decode_hint, doc_id, lang, source FROM documents)"
BLOCKS = f"(SELECT range AS start_id, least(range + {BLOCK}, n) AS end_id FROM (SELECT count(*) AS n FROM documents), range(0, n, {BLOCK}))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.of_documents(t(spark, sf_dir, "documents"))


def _mixed(x: str) -> str:
    step = lambda v, bits, by: f"((xor({v}, {v} >> {bits}) * {by}::UHUGEINT) % {TWO64})"
    return f"list_transform(list_transform(list_transform([({x} + {wrap64.GOLDEN}::UHUGEINT) % {TWO64}], lambda z: {step('z', 30, wrap64.FIRST)}), lambda z: {step('z', 27, wrap64.SECOND)}), lambda z: xor(z, z >> 31))[1]"


def _long(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808::UHUGEINT THEN ({x}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {x}::BIGINT END)"


SHUFFLED = f"(SELECT *, row_number() OVER (ORDER BY k, start_id) - 1 AS position FROM (SELECT *, {_mixed(f'xor({SEED ^ (EPOCH * wrap64.GOLDEN) % (1 << 64)}::UHUGEINT, start_id::UHUGEINT)')} AS k FROM {BLOCKS}))"
RUN = wrap64.fnv1a(b"documents")


def _unit(stream: int) -> str:
    turned = lambda x, k: (x << k | x >> (64 - k)) % (1 << 64)
    fixed = (RUN + turned(SEED, 7) + turned(stream, 29) + turned(EPOCH, 41)) % (1 << 64)
    z = _mixed(f"(((sample_id::UHUGEINT << 17) + {fixed}::UHUGEINT) % {TWO64})")
    return f"list_transform([{z}], lambda v: (((v >> 32)::DOUBLE * 4294967296.0 + (v % 4294967296::UHUGEINT)::DOUBLE) / 18446744073709551616.0)::FLOAT)[1]"


LOW, HIGH = batching.band(TARGET, MOST)
NUMBERED = f"(SELECT m.sample_id, m.byte_length, b.start_id, b.position % {WORLD} AS rank, m.sample_id - b.start_id AS spot FROM {MANIFEST} m JOIN {SHUFFLED} b ON m.sample_id >= b.start_id AND m.sample_id < b.end_id)"
CUT = f"n >= {ROWS} OR size >= {TARGET} OR size + x.byte_length > {MOST} OR (size >= {LOW} AND size + x.byte_length > {HIGH})"
FOLDED = f"""WITH RECURSIVE x AS MATERIALIZED {NUMBERED}, f AS (
    SELECT start_id, rank, spot, sample_id, byte_length, 0 AS batch_no, 1 AS n, byte_length AS size FROM x WHERE spot = 0
    UNION ALL
    SELECT x.start_id, x.rank, x.spot, x.sample_id, x.byte_length, CASE WHEN {CUT} THEN batch_no + 1 ELSE batch_no END, CASE WHEN {CUT} THEN 1 ELSE n + 1 END, CASE WHEN {CUT} THEN x.byte_length ELSE size + x.byte_length END
    FROM f JOIN x ON x.start_id = f.start_id AND x.spot = f.spot + 1)
    """


def rank_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    order = ranges.ranked(ranges.blocks(t(spark, sf_dir, "documents"), BLOCK), SEED, EPOCH, WORLD)
    placed = rows.withColumn("range_start", (F.col("sample_id") - F.col("sample_id") % BLOCK))
    cut = batching.by_bytes(placed, "range_start", ROWS, TARGET, MOST)
    return cut.join(order.select(F.col("start_id").alias("range_start"), "rank"), "range_start")


@query(FOLDED + "SELECT start_id AS range_start, batch_no::BIGINT AS batch_no, min(sample_id) AS first_id, max(sample_id) AS last_id, count(*) AS n, sum(byte_length)::BIGINT AS bytes, rank::INT AS rank FROM f WHERE rank = 0 GROUP BY ALL")
def flagship_rank_batches(spark, sf_dir):
    """The byte-bounded batches of rank 0's work ranges in one epoch."""
    return rank_batches(spark, sf_dir).filter("rank = 0")


@query(FOLDED + "SELECT start_id AS range_start, batch_no::BIGINT AS batch_no, min(sample_id) AS first_id, max(sample_id) AS last_id, count(*) AS n, sum(byte_length)::BIGINT AS bytes FROM f GROUP BY start_id, batch_no")
def batch_bytes(spark, sf_dir):
    return rank_batches(spark, sf_dir).drop("rank")


@query(f"SELECT sample_id, location, byte_offset, byte_length, decode_hint FROM {MANIFEST}")
def manifest_dense_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("sample_id", "location", "byte_offset", "byte_length", "decode_hint")


@query("SELECT count(*) AS n, min(doc_id) AS least, max(doc_id) AS greatest, count(DISTINCT doc_id) AS n_distinct, count(*) = count(DISTINCT doc_id) AND coalesce(min(doc_id), 0) = 0 AND coalesce(max(doc_id) + 1, 0) = count(*) AS dense FROM documents")
def manifest_dense_check(spark, sf_dir):
    return manifest.gaps(t(spark, sf_dir, "documents"), "doc_id")


BAD = "(SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'f://x' END AS location, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS byte_offset, o_orderkey % 11 AS byte_length FROM orders)"


@query(f"SELECT sample_id, CASE WHEN trim(location) = '' THEN 'blank_location' WHEN (byte_offset IS NULL) <> (byte_length IS NULL) THEN 'partial_range' WHEN byte_length <= 0 THEN 'empty_range' END AS error FROM {BAD} ORDER BY 1")
def manifest_validate(spark, sf_dir):
    made = t(spark, sf_dir, "orders").selectExpr("o_orderkey AS sample_id", "CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'f://x' END AS location", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS byte_offset", "o_orderkey % 11 AS byte_length")
    return made.select("sample_id", manifest.error_kind(F.col("location"), F.col("byte_offset"), F.col("byte_length")).alias("error"))


@query(f"SELECT sample_id, location FROM {MANIFEST} WHERE sample_id >= 20 AND sample_id < 120")
def range_slice(spark, sf_dir):
    """A slice of a stored snapshot: Parquet sorted by id, so the scan skips what is outside."""
    held = snapshot.Store(spark, new_folder(spark, "store"))
    rows = held.get(held.put(docs(spark, sf_dir)))
    return manifest.sliced(rows, 20, 120, rows.count()).select("sample_id", "location")


@query(f"SELECT sample_id, sample_id || chr(9) || location || chr(9) || '' || chr(9) || byte_length || chr(9) || decode_hint AS line FROM {MANIFEST}")
def manifest_canonical_line(spark, sf_dir):
    return docs(spark, sf_dir).select("sample_id", manifest.canonical_line().alias("line"))


@query(f"SELECT sha256('schema_version=0' || chr(10) || string_agg(sample_id || chr(9) || location || chr(9) || '' || chr(9) || byte_length || chr(9) || decode_hint || chr(10), '' ORDER BY sample_id)) AS hash FROM {MANIFEST}")
def manifest_hash(spark, sf_dir):
    return spark.createDataFrame([(manifest.content_hash(docs(spark, sf_dir)),)], "hash string")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(split_part(url, '://', 1)) ELSE 'file' END AS scheme FROM pages")
def location_scheme(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", manifest.scheme(F.col("url")).alias("scheme"))


@query(f"SELECT doc_id, {_long(_mixed('doc_id::UHUGEINT'))} AS mixed FROM documents")
def splitmix_key(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", wrap64.splitmix(F.col("doc_id")).alias("mixed"))


HINT = "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'video;frames=' || (o_orderkey % 40) || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ';stream_id=0' END || ';codec=' || CASE WHEN o_orderkey % 7 = 0 THEN 'unsupported' ELSE 'h264' END || CASE WHEN o_orderkey % 11 = 0 THEN ';corrupt=true' ELSE '' END END"
STATE = "CASE WHEN k % 13 = 0 THEN 'missing_stream' WHEN k % 11 = 0 THEN 'corrupt_media' WHEN k % 7 = 0 THEN 'unsupported_codec' WHEN k % 5 = 0 THEN 'missing_stream' WHEN k % 40 < 4 THEN 'short_media' END"
MEDIA = f"(SELECT o_orderkey AS media_id, o_orderkey % 40 AS frames, {STATE.replace('k %', 'o_orderkey %')} AS state FROM orders)"


def hints(spark, sf_dir):
    """The hints, over as many tasks as there are cores: the table is one file."""
    made = t(spark, sf_dir, "orders").select("o_orderkey").repartition(spark.sparkContext.defaultParallelism).selectExpr("o_orderkey AS media_id", f"{HINT} AS hint")
    return made.select("media_id", "hint", media.media_state(F.col("hint"), 4).alias("state"), manifest.hint_field(F.col("hint"), "frames").try_cast("long").alias("frames"))


@query("SELECT o_orderkey AS media_id, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 40)::VARCHAR END AS frames, CASE WHEN o_orderkey % 13 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'unsupported' ELSE 'h264' END END AS codec, o_orderkey % 13 <> 0 AND o_orderkey % 11 = 0 AS corrupt FROM orders")
def hint_fields(spark, sf_dir):
    made = hints(spark, sf_dir).select("media_id", manifest.hint_fields(F.col("hint")).alias("fields"))
    f = F.col("fields")
    return made.select("media_id", f["frames"].alias("frames"), f["codec"].alias("codec"), F.coalesce(manifest.truthy(f["corrupt"]), F.lit(False)).alias("corrupt"))


@query(f"SELECT coalesce(state, 'ok') AS state, count(*) AS n, sum(CASE WHEN state IS NULL AND (frames - 4) % 3 <> 0 THEN 1 ELSE 0 END)::BIGINT AS tail_drops FROM {MEDIA} GROUP BY 1")
def clip_failures(spark, sf_dir):
    tail = F.sum(F.when(F.col("state").isNull() & ((F.col("frames") - 4) % 3 != 0), 1).otherwise(0).cast("long"))
    return hints(spark, sf_dir).groupBy(F.coalesce("state", F.lit("ok")).alias("state")).agg(F.count("*").alias("n"), tail.alias("tail_drops"))


CLIPS = f"(SELECT row_number() OVER (ORDER BY media_id, c) - 1 AS sample_id, media_id, c AS clip_start FROM (SELECT media_id, unnest(range(0, frames - 3, 3)) AS c FROM {MEDIA} WHERE state IS NULL))"


def clip_rows(spark, sf_dir):
    return manifest.with_dense_ids(media.clips(hints(spark, sf_dir).filter("state IS NULL"), 4, 3), "media_id", "clip_start")


@query(f"SELECT * FROM {CLIPS}")
def clip_index(spark, sf_dir):
    return clip_rows(spark, sf_dir).select("sample_id", "media_id", "clip_start")


@query(f"SELECT sample_id, sha256(concat_ws('|', 'm', media_id, 'f://' || media_id, 0, clip_start, 4, 3, 'native', {SEED}, {EPOCH})) AS clip_id FROM {CLIPS}")
def clip_ids(spark, sf_dir):
    uri = F.concat(F.lit("f://"), F.col("media_id").cast("string"))
    return clip_rows(spark, sf_dir).select("sample_id", media.clip_id("m", F.col("media_id"), uri, F.lit(0), F.col("clip_start"), 4, 3, "native", SEED, EPOCH).alias("clip_id"))


@query(f"SELECT * FROM {CLIPS} WHERE sample_id % 4 = 1")
def clip_rank_shard(spark, sf_dir):
    """The clips of rank 1 of 4."""
    return clip_rows(spark, sf_dir).filter(F.pmod("sample_id", F.lit(4)) == 1).select("sample_id", "media_id", "clip_start")


CHUNK = ["s_suppkey AS media_id", "k AS chunk_index", "k * 1000 AS start_ms", "(k + 1) * 1000 AS end_ms", "k * 10000 + (s_suppkey + k * k) % 7 * 100 AS start_byte", "(k + 1) * 10000 + CASE WHEN s_suppkey % 9 = 0 AND k = 3 THEN 5000 ELSE 0 END AS end_byte", "CASE WHEN k % 3 = s_suppkey % 4 THEN 1 ELSE 0 END AS keyframe"]
CHUNKS = f"(SELECT {', '.join(CHUNK)} FROM supplier, (SELECT range AS k FROM range(0, 8)))"


def chunk_rows(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("k")).selectExpr(*CHUNK)


@query(f"SELECT media_id, count(*) AS n_chunks, sum(bad)::BIGINT AS faults, sum(keyframe)::BIGINT AS keyframes, sum(bad) = 0 AND sum(keyframe) > 0 AS valid FROM (SELECT *, CASE WHEN start_byte < lag(end_byte) OVER (PARTITION BY media_id ORDER BY chunk_index) THEN 1 ELSE 0 END AS bad FROM {CHUNKS}) GROUP BY media_id")
def sidecar_check(spark, sf_dir):
    return media.faulty_chunks(chunk_rows(spark, sf_dir))


STARTS = "(SELECT range AS clip_id, range * 1700 AS a, range * 1700 + 900 + range % 3 * 1500 AS e FROM range(0, 5))"


@query(f"""WITH s AS (SELECT c.*, x.clip_id, x.a, x.e FROM {CHUNKS} c, {STARTS} x WHERE media_id % 9 <> 0 AND media_id % 4 <> 3),
g AS (SELECT *, coalesce(max(CASE WHEN keyframe = 1 AND start_ms <= a THEN start_ms END) OVER (PARTITION BY media_id, clip_id), min(CASE WHEN keyframe = 1 THEN start_ms END) OVER (PARTITION BY media_id, clip_id)) AS anchor_ms FROM s),
h AS (SELECT *, start_byte - lag(end_byte) OVER (PARTITION BY media_id, clip_id ORDER BY chunk_index) AS space FROM g WHERE start_ms >= anchor_ms AND start_ms < e),
i AS (SELECT *, CASE WHEN space > 100 THEN row_number() OVER (PARTITION BY media_id, clip_id, coalesce(space > 100, false) ORDER BY space DESC, chunk_index DESC) END AS r FROM h),
j AS (SELECT *, sum(CASE WHEN space IS NULL OR r <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, clip_id ORDER BY chunk_index) AS part FROM i),
k AS (SELECT media_id, clip_id, anchor_ms, part, min(start_byte) AS a, max(end_byte) AS b FROM j GROUP BY ALL)
SELECT media_id, clip_id, anchor_ms, count(*) AS n_ranges, min(a) AS first_byte, max(b) AS last_byte, sum(b - a)::BIGINT AS planned_bytes FROM k GROUP BY media_id, clip_id, anchor_ms""")
def range_plan(spark, sf_dir):
    """Byte ranges for five clips of each valid medium: 3 ranges at most, gaps to 100 bytes read through."""
    checked = media.faulty_chunks(chunk_rows(spark, sf_dir)).filter("valid").select("media_id")
    good = chunk_rows(spark, sf_dir).join(checked, "media_id")
    k = F.col("clip_id")
    wanted = checked.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("clip_id")).select("media_id", "clip_id", (k * 1700).alias("clip_start_ms"), (k * 1700 + 900 + k % 3 * 1500).alias("clip_end_ms"))
    return media.range_plan(good, wanted, 3, 100)


@query("SELECT source AS label, dense_rank() OVER (ORDER BY source) - 1 AS label_id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def label_dictionary(spark, sf_dir):
    return manifest.label_ids(t(spark, sf_dir, "documents"), "source")


@query(f"SELECT sample_id, dense_rank() OVER (ORDER BY lang) - 1 AS label_id FROM {MANIFEST}")
def label_ids(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("label", manifest.label_of(F.concat("lang", F.lit("/"), "source")))
    return rows.join(manifest.label_ids(rows, "label"), "label", "left").select("sample_id", "label_id")


@query("SELECT lang AS label, dense_rank() OVER (ORDER BY first) - 1 AS label_id FROM (SELECT lang, min(doc_id) AS first FROM documents GROUP BY lang)")
def label_first_seen(spark, sf_dir):
    first = t(spark, sf_dir, "documents").groupBy(F.col("lang").alias("label")).agg(F.min("doc_id").alias("first"))
    return manifest.with_dense_ids(first, "first", name="label_id").select("label", "label_id")


@query("SELECT count(*) AS n, count(label) AS labelled, count(DISTINCT label) AS labels, count(*) = count(label) AND count(DISTINCT label) >= 2 AS automatic FROM (SELECT CASE WHEN contains(p, '/') AND trim(split_part(p, '/', 1)) <> '' THEN trim(split_part(p, '/', 1)) END AS label FROM (SELECT lang || '/' || source AS p FROM documents))")
def label_mode_auto(spark, sf_dir):
    seen = t(spark, sf_dir, "documents").select(manifest.label_of(F.concat("lang", F.lit("/"), "source")).alias("label"))
    out = seen.agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.countDistinct("label").alias("labels"))
    return out.withColumn("automatic", (F.col("n") == F.col("labelled")) & (F.col("labels") >= 2))


@query(f"SELECT m.sample_id // 32 AS batch_id, count(*) AS n, count(l.quality) AS labelled, count(l.quality) IN (0, count(*)) AS consistent FROM {MANIFEST} m LEFT JOIN labels l ON l.doc_id = m.doc_id GROUP BY 1")
def batch_label_all_or_none(spark, sf_dir):
    joined = docs(spark, sf_dir).join(t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    out = joined.groupBy(F.expr("sample_id div 32").alias("batch_id")).agg(F.count("*").alias("n"), F.count("quality").alias("labelled"))
    return out.withColumn("consistent", (F.col("labelled") == 0) | (F.col("labelled") == F.col("n")))


@query(f"SELECT sample_id, location FROM {MANIFEST} WHERE contains(lower(location), 'src1') OR contains(lower(decode_hint), 'src1')")
def manifest_search(spark, sf_dir):
    return docs(spark, sf_dir).filter(manifest.found_in("SRC1", F.col("location"), F.col("decode_hint"))).select("sample_id", "location")


@query("SELECT c_custkey, url_encode(c_name) AS encoded FROM customer")
def percent_encode(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", manifest.percent_encoded(F.col("c_name")).alias("encoded"))


@query(f"SELECT * FROM {BLOCKS}")
def work_ranges(spark, sf_dir):
    return ranges.blocks(t(spark, sf_dir, "documents"), BLOCK)


@query(f"SELECT start_id, end_id, {_long('k')} AS shuffle_key, position FROM {SHUFFLED}")
def shuffled_blocks(spark, sf_dir):
    return ranges.shuffled(ranges.blocks(t(spark, sf_dir, "documents"), BLOCK), SEED, EPOCH)


@query(f"SELECT (position % {WORLD})::INT AS rank, count(*) AS n_blocks, sum(end_id - start_id)::BIGINT AS n_samples FROM {SHUFFLED} GROUP BY 1")
def rank_assignment(spark, sf_dir):
    return ranges.ranked(ranges.blocks(t(spark, sf_dir, "documents"), BLOCK), SEED, EPOCH, WORLD).groupBy("rank").agg(F.count("*").alias("n_blocks"), F.sum(F.col("end_id") - F.col("start_id")).alias("n_samples"))


@query(f"SELECT start_id, end_id, ((row_number() OVER (ORDER BY k, start_id) - 1) % 3)::INT AS rank FROM {SHUFFLED} WHERE position % 4 <> 0")
def repartition_unissued(spark, sf_dir):
    """Blocks that are not issued (position divides by 4: issued), over three ranks."""
    whole = ranges.shuffled(ranges.blocks(t(spark, sf_dir, "documents"), BLOCK), SEED, EPOCH)
    return ranges.unissued(whole, whole.filter("position % 4 = 0"), SEED, EPOCH, 3).select("start_id", "end_id", "rank")


LIVE = "SELECT o_orderkey * 100 - CASE WHEN o_orderkey % 7 = 0 THEN 30 ELSE 0 END AS start_id, o_orderkey * 100 + 100 + CASE WHEN o_orderkey % 11 = 0 THEN 120 ELSE 0 END AS end_id FROM orders"


@query(f"SELECT start_id, end_id, next_start FROM (SELECT *, lead(start_id) OVER (ORDER BY start_id, end_id) AS next_start FROM ({LIVE})) WHERE end_id > next_start")
def no_overlap(spark, sf_dir):
    """Live ranges that share ids with their neighbours, in a set where some do."""
    t(spark, sf_dir, "orders").createOrReplaceTempView("tidemill_orders")
    return ranges.overlaps(spark.sql(LIVE.replace("FROM orders", "FROM tidemill_orders"))).select("start_id", "end_id", "next_start")


LEASES = ["o_orderkey AS lease_id", "o_orderkey * 100 AS start_id", "o_orderkey * 100 + 100 AS end_id", "o_orderkey * 100 - 20 + o_orderkey % 150 AS cursor", "o_orderkey % 60 AS expires_ms"]


@query(f"SELECT lease_id, least(greatest(cursor, start_id), end_id) AS start_id, end_id FROM (SELECT {', '.join(LEASES)} FROM orders) WHERE expires_ms <= 30 AND least(greatest(cursor, start_id), end_id) < end_id")
def lease_expiry_requeue(spark, sf_dir):
    return ranges.remainders(t(spark, sf_dir, "orders").selectExpr(*LEASES), 30)


PROGRESS = ["user_id % 50 AS lease_id", "event_id AS seq", "user_id % 4 AS node", "CASE WHEN event_id % 17 = 0 THEN 9 ELSE user_id % 4 END AS owner", "cast(0 AS BIGINT) AS start_id", "cast(1000 AS BIGINT) AS end_id", "event_id * 7919 % 1100 AS cursor"]


@query(f"SELECT lease_id, seq, CASE WHEN node <> owner THEN 'not_owner' WHEN cursor NOT BETWEEN 0 AND 1000 THEN 'out_of_range' WHEN cursor < ahead THEN 'backwards' WHEN cursor >= 1000 THEN 'completed' ELSE 'accepted' END AS verdict FROM (SELECT *, max(CASE WHEN node = owner AND cursor BETWEEN 0 AND 1000 THEN cursor END) OVER (PARTITION BY lease_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM (SELECT {', '.join(PROGRESS)} FROM events))")
def lease_progress_accept(spark, sf_dir):
    return ranges.accepted(t(spark, sf_dir, "events").selectExpr(*PROGRESS)).select("lease_id", "seq", "verdict")


B = "(event_id % 40) * 64"
LOG = f"CASE WHEN event_type = 'click' THEN 'C ' || ({B}) || ' ' || ({B} + 64) WHEN event_id % 3 = 0 THEN 'bad line' ELSE 'P ' || ({B}) || ' ' || ({B} + 64) || ' ' || ({B} + event_id % 80) END"
REPLAY = f"(SELECT {B} + 64 AS end_id, bool_or(event_type = 'click') AS completed, max(CASE WHEN event_type <> 'click' THEN {B} + event_id % 80 END) AS cursor FROM events WHERE event_type = 'click' OR event_id % 3 <> 0 GROUP BY 1)"


@query(f"SELECT * FROM {REPLAY}")
def log_replay(spark, sf_dir):
    return ranges.replayed(t(spark, sf_dir, "events").selectExpr(f"{LOG} AS line"))


@query(f"SELECT greatest(b.start_id, coalesce(r.cursor, b.start_id)) AS start_id, b.end_id FROM {BLOCKS} b LEFT JOIN {REPLAY} r USING (end_id) WHERE NOT coalesce(r.completed, false) AND greatest(b.start_id, coalesce(r.cursor, b.start_id)) < b.end_id")
def lease_recovery(spark, sf_dir):
    return ranges.recovered(ranges.blocks(t(spark, sf_dir, "documents"), BLOCK), log_replay(spark, sf_dir))


@query(f"SELECT sample_id // 32 AS batch_id, min(sample_id) AS first_id, max(sample_id) AS last_id, count(*) AS n, sum(byte_length)::BIGINT AS bytes FROM {MANIFEST} GROUP BY 1")
def batch_fixed(spark, sf_dir):
    return batching.fixed(docs(spark, sf_dir), 32)


@query(f"SELECT sample_id // 32 AS batch_id, list(sample_id ORDER BY sample_id) AS sample_ids, list_prepend(0::BIGINT, list(c ORDER BY sample_id)) AS offsets FROM (SELECT *, sum(byte_length) OVER (PARTITION BY sample_id // 32 ORDER BY sample_id)::BIGINT AS c FROM {MANIFEST}) GROUP BY 1")
def batch_offsets(spark, sf_dir):
    return batching.packed(docs(spark, sf_dir), 32)


SIZES = f"(SELECT sample_id // 8 AS batch_id, (sample_id // 8) % 2 AS stream, max(sample_id) AS last_id, sum(byte_length)::BIGINT AS bytes FROM {MANIFEST} GROUP BY ALL)"


def sizes(spark, sf_dir):
    return batching.fixed(docs(spark, sf_dir), 8).select("batch_id", (F.col("batch_id") % 2).alias("stream"), "last_id", "bytes")


@query(f"SELECT batch_id, stream, last_id, bytes, p50, p95, CASE WHEN p50 > 0 THEN (p95 * 1000 + p50 // 2) // p50 ELSE 0 END AS ratio_milli FROM (SELECT *, w[(len(w) - 1) * 50 // 100 + 1] AS p50, w[(len(w) - 1) * 95 // 100 + 1] AS p95 FROM (SELECT *, list_sort(list(bytes) OVER (PARTITION BY stream ORDER BY batch_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)) AS w FROM {SIZES}))")
def batch_rolling_p95(spark, sf_dir):
    return batching.jitter(sizes(spark, sf_dir), "stream", "batch_id")


@query(f"SELECT *, max(last_id) OVER (PARTITION BY stream ORDER BY batch_id) + 1 AS cursor FROM {SIZES}")
def delivery_cursor(spark, sf_dir):
    return batching.cursors(sizes(spark, sf_dir), "stream", "batch_id")


@query(f"SELECT batch_id, bytes, bytes > 60000 AS exceeds FROM {SIZES}")
def inflight_check(spark, sf_dir):
    return sizes(spark, sf_dir).select("batch_id", "bytes", (F.col("bytes") > 60_000).alias("exceeds"))


TOKENS = "(SELECT conv_id, turn, list_concat([1::BIGINT], list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w)::BIGINT + 2), [2::BIGINT]) AS ids FROM conversations)"


def tokens(spark, sf_dir):
    """Each turn as a sequence of small numbers (word lengths) between 1 and 2, where a vocabulary's ids would be."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    ids = F.transform(words, lambda w: (F.length(w) + 2).cast("long"))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.array(F.lit(1).cast("long")), ids, F.array(F.lit(2).cast("long"))).alias("ids"))


@query(f"SELECT conv_id, turn, ids FROM {TOKENS}")
def bos_eos(spark, sf_dir):
    return tokens(spark, sf_dir)


@query(f"""WITH w AS (SELECT conv_id, turn, ids, unnest(range(0, (greatest(0, least(ceil(len(ids) / 12.0)::BIGINT - 1, ceil(greatest(len(ids) - 16, 0) / 12.0)::BIGINT)) + 1))) AS k FROM {TOKENS})
SELECT conv_id, turn, k::INT AS window_no, list_concat(ids[k * 12 + 1 : k * 12 + 16], list_transform(range(0, 16 - len(ids[k * 12 + 1 : k * 12 + 16])), lambda x: 0::BIGINT)) AS token_ids, list_transform(range(0, 16), lambda x: CASE WHEN x < len(ids[k * 12 + 1 : k * 12 + 16]) THEN 1 ELSE 0 END) AS mask FROM w""")
def text_windows(spark, sf_dir):
    return media.text_windows(tokens(spark, sf_dir), "ids", 16, 12, 0)


RAW = "encode(text) || CASE doc_id % 5 WHEN 0 THEN '\\xC3'::BLOB WHEN 1 THEN '\\xFF\\xFE'::BLOB ELSE ''::BLOB END"


@query(f"SELECT doc_id, TRY(decode({RAW})) IS NOT NULL AS valid FROM documents WHERE text IS NOT NULL")
def utf8_policy(spark, sf_dir):
    """Which payloads are UTF-8, where two in five have bytes behind the text that aren't."""
    tail = F.when(F.col("doc_id") % 5 == 0, F.lit(b"\xc3")).when(F.col("doc_id") % 5 == 1, F.lit(b"\xff\xfe")).otherwise(F.lit(b""))
    raw = t(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.concat(F.encode("text", "UTF-8"), tail).alias("raw"))
    return raw.select("doc_id", F.is_valid_utf8(F.col("raw").cast("string")).alias("valid"))


@query("SELECT vec_id, len(embedding) AS n, list_sum(list_transform(e, lambda x: (x * 1000)::INT))::BIGINT AS total, len(e)::INT AS kept FROM (SELECT *, list_concat(embedding, list_transform(range(0, 100), lambda x: 0::FLOAT))[1:100] AS e FROM embeddings)")
def audio_pad_truncate(spark, sf_dir):
    """Frames padded or cut to 100; they are scaled as 32-bit floats, as in the SQL. No frames at all count as none, unknown ones have no part in the total."""
    frames = F.coalesce("embedding", F.array().cast("array<float>"))
    made = t(spark, sf_dir, "embeddings").withColumn("e", media.padded(frames, 100, F.lit(0).cast("float")))
    scaled = F.transform(F.filter("e", lambda x: x.isNotNull()), lambda x: F.rint(x * F.lit(1000).cast("float")).cast("long"))
    total = F.when(F.exists("e", lambda x: x.isNotNull()), F.aggregate(scaled, F.lit(0).cast("long"), lambda a, x: a + x))
    return made.select("vec_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("n"), total.alias("total"), F.size("e").alias("kept"))


@query("SELECT l_orderkey, l_linenumber, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (l_partkey * 37 % 70000 - 35000) / 32768.0::DOUBLE)) AS x FROM lineitem")
def pcm_scale(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", media.pcm(F.expr("l_partkey * 37 % 70000 - 35000"), 16).alias("x"))


@query("SELECT vec_id, list_transform(range(0, 32), lambda f: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (embedding[2 * f + 1]::DOUBLE + embedding[2 * f + 2]::DOUBLE) / 2))) AS mono FROM embeddings")
def downmix(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", media.downmixed(F.col("embedding").cast("array<double>"), 2).alias("mono"))


FACTOR = lambda k: f"(1.0::FLOAT + ({_unit(k)} * 2.0::FLOAT - 1.0::FLOAT) * 0.4::FLOAT)"


@query(f"SELECT sample_id, least(floor(33::FLOAT * {_unit(1)}), 32)::INT AS top, least(floor(33::FLOAT * {_unit(2)}), 32)::INT AS left, {_unit(3)} < 0.5::FLOAT AS flip, {FACTOR(11)} AS brightness, {FACTOR(12)} AS contrast, {FACTOR(13)} AS saturation FROM {MANIFEST}")
def aug_decisions(spark, sf_dir):
    return media.augmentation(docs(spark, sf_dir), RUN, SEED, EPOCH, 256, 256, 224, 0.5, 0.4)


WEIGHTS, OFFSET = mixing.whole_weights([0.5, 0.25, 0.15, 0.1]), mixing.tie_offset(SEED, EPOCH, 4)
SOURCES = "(SELECT doc_id, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS source_no, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pick_no FROM documents)"
#: One tick after the other until every source has run out: all active gain their weight, the greatest (of equals the nearest after the offset) is picked and pays the sum.
PLAN = f"""WITH RECURSIVE have AS MATERIALIZED (SELECT list(n ORDER BY source_no) AS counts FROM (SELECT source_no, count(*) AS n FROM {SOURCES} GROUP BY 1)),
f AS (
    SELECT 0::BIGINT AS round, -1::BIGINT AS tick, NULL::INT AS source_no, NULL::BIGINT AS pick_no, false AS given, [0, 0, 0, 0]::BIGINT[] AS state, [0, 0, 0, 0]::BIGINT[] AS done, [true, true, true, true] AS active FROM have
    UNION ALL
    SELECT round + 1, tick + CASE WHEN left_over THEN 1 ELSE 0 END, pick - 1, done[pick], left_over,
        list_transform(range(1, 5), lambda k: gained[k] - CASE WHEN k = pick THEN total ELSE 0 END),
        list_transform(range(1, 5), lambda k: done[k] + CASE WHEN k = pick AND left_over THEN 1 ELSE 0 END),
        list_transform(range(1, 5), lambda k: active[k] AND (k <> pick OR left_over))
    FROM (SELECT *, done[pick] < counts[pick] AS left_over FROM (
        SELECT *, list_sort(list_transform(list_filter(range(1, 5), lambda k: active[k]), lambda k: [-gained[k], (k - 1 - {OFFSET} + 4) % 4, k]))[1][3]::INT AS pick FROM (
            SELECT f.*, counts, list_transform(range(1, 5), lambda k: state[k] + CASE WHEN active[k] THEN ({WEIGHTS})[k] ELSE 0 END) AS gained, list_sum(list_transform(range(1, 5), lambda k: CASE WHEN active[k] THEN ({WEIGHTS})[k] ELSE 0 END))::BIGINT AS total
            FROM f, have WHERE list_bool_or(active)))))
"""
GIVEN = "(SELECT tick, source_no, pick_no FROM f WHERE given)"


def sources(spark, sf_dir):
    """(doc_id, source_no, pick_no): each language a source, its documents in order."""
    rows = t(spark, sf_dir, "documents").select("doc_id", "lang")
    labelled = rows.join(manifest.label_ids(rows, "lang").select(F.col("label").alias("lang"), F.col("label_id").cast("int").alias("source_no")), "lang")
    first = manifest.with_dense_ids(labelled, "source_no", "doc_id", name="at")
    starts = first.groupBy("source_no").agg(F.min("at").alias("start"))
    return first.join(starts, "source_no").select("doc_id", "source_no", (F.col("at") - F.col("start")).alias("pick_no"))


def plan(spark, sf_dir):
    """The mix of all languages to their ends."""
    counts = t(spark, sf_dir, "documents").filter("lang IS NOT NULL").groupBy("lang").count().orderBy("lang").collect()
    return mixing.drained(spark, WEIGHTS, [r[1] for r in counts], OFFSET)


@query(PLAN + f"SELECT * FROM {GIVEN}")
def mix_schedule(spark, sf_dir):
    return plan(spark, sf_dir)


@query(PLAN + f"SELECT tick, source_no, doc_id FROM {GIVEN} JOIN {SOURCES} USING (source_no, pick_no)")
def mix_interleave(spark, sf_dir):
    """Every document at its tick."""
    return mixing.interleaved(plan(spark, sf_dir), sources(spark, sf_dir)).select("tick", "source_no", "doc_id")


@query(PLAN + f"SELECT source_no, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE AS ratio FROM {GIVEN} JOIN {SOURCES} USING (source_no, pick_no) GROUP BY source_no")
def mix_ratio(spark, sf_dir):
    return mixing.realised(mix_interleave(spark, sf_dir), 4)


@query(PLAN + f"SELECT source_no, sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END)::BIGINT AS starved FROM (SELECT *, tick - lag(tick) OVER (PARTITION BY source_no ORDER BY tick) AS gap FROM {GIVEN}) GROUP BY 1")
def mix_starvation(spark, sf_dir):
    return mixing.starvation(plan(spark, sf_dir), 6)


@query("SELECT doc_id, sha256('T' || text || text) AS digest, octet_length(encode('T' || text || text))::INT AS size FROM documents")
def transform_prefix_dup(spark, sf_dir):
    """A byte transform (a literal, then the sample twice) under the usual cap, whose breach is an error: expressions, so nothing leaves the JVM."""
    rows = t(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"))
    out = transforms.applied(rows, transforms.Transform.of_source("def f(sample):\n    return b'T' + sample + sample"))
    return out.select("doc_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))


@query("SELECT user_id % 16 AS node, count(*) AS reports, sum(event_id % 100)::BIGINT AS inflight, max(event_id) AS last_seen, max(event_id) < (SELECT max(event_id) FROM events) - 20 AS stale FROM events GROUP BY 1")
def cluster_summary(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    nodes = events.groupBy((F.col("user_id") % 16).alias("node")).agg(F.count("*").alias("reports"), F.sum(F.col("event_id") % 100).alias("inflight"), F.max("event_id").alias("last_seen"))
    return nodes.crossJoin(events.agg(F.max("event_id").alias("now"))).withColumn("stale", F.col("last_seen") < F.col("now") - 20).drop("now")


@query("SELECT event_type, count(*) AS n, sum(event_id % 997)::BIGINT AS total, max(event_id % 997) AS most, sum(event_id % 997)::BIGINT // count(*) AS mean FROM events GROUP BY 1")
def duration_stats(spark, sf_dir):
    d = F.col("event_id") % 997
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(d).alias("total"), F.max(d).alias("most")).withColumn("mean", F.floor(F.col("total") / F.col("n")).cast("long"))
