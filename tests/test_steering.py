"""Mixing policies, bands, leases, resume tokens, video tables, resolvers, snapshots under contention, controllers, streams."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemill import api
from tidemill.operators import batching, control, manifest, media, mixing, ranges, resume, video
from tidemill.sources import resolvers, snapshot, tsv
from tidemill.streaming import progress


def test_exhaustion_and_checks(spark):
    weights, counts = [0.5, 0.25, 0.25], [40, 6, 50]
    plan = mixing.mixed(spark, weights, counts, 7, 11)
    assert plan.count() == 96
    whole, offset = mixing.whole_weights(weights), mixing.tie_offset(7, 11, 3)
    tick, source = mixing.first_exhausted(whole, counts, offset)
    picks = mixing.period(whole, offset)
    n = [0, 0, 0]
    for at in range(1000):
        s = picks[at % len(picks)]
        if n[s] == counts[s]:
            break
        n[s] += 1
    assert (tick, source) == (at, s)
    assert mixing.mixed(spark, weights, counts, 7, 11, "error", tick).count() == tick
    with pytest.raises(ValueError, match=f"source {source} has run out at tick {tick}"):
        mixing.mixed(spark, weights, counts, 7, 11, "error", tick + 1)
    for bad in (lambda: mixing.mixed(spark, weights, [1], 0, 0), lambda: mixing.mixed(spark, weights, counts, 0, 0, "other"), lambda: mixing.checked_sources([], []), lambda: mixing.checked_sources([4, 8], [1, 1]), lambda: mixing.checked_sources([4], [1], 2), lambda: mixing.shared_cap([])):
        with pytest.raises(ValueError):
            bad()
    mixing.checked_sources([4, 4], [1, 2])
    assert mixing.shared_cap([100, 70], 90) == 70 and mixing.shared_cap([100, 70], 50, 60) == 50
    with pytest.raises(Exception, match="over the shared cap"):
        mixing.within_cap(spark.createDataFrame([(80,)], "bytes long"), 70).collect()
    assert [r[0] for r in mixing.snapshots(plan, 32).orderBy("tick").collect()] == [32, 64]
    one = spark.createDataFrame([(0,), (0,), (2,)], "source_no int")
    assert [tuple(r) for r in mixing.realised(one, 4).orderBy("source_no").collect()] == [(0, 2, 2 / 3), (1, 0, 0.0), (2, 1, 1 / 3), (3, 0, 0.0)]
    assert {r["ratio"] for r in mixing.realised(one.limit(0), 2).collect()} == {0.0}
    mixed = api.mix([spark.range(k).select(F.col("id").alias("batch_id"), F.lit(10).alias("bytes")) for k in (40, 6, 50)], weights, 7, 11, caps=[20, 30, 40])
    assert mixed.count() == 96 and mixed.select("tick").distinct().count() == 96


def test_long_periods(spark):
    whole = mixing.whole_weights([1 / 3, 2 / 3])
    assert sum(whole) == 1_000_000
    plan = mixing.drained(spark, [7, 13], [3000, 5000], 1)
    assert plan.count() == 8000 and plan.groupBy("source_no").count().orderBy("source_no").collect() == [(0, 3000), (1, 5000)]


def test_bands_against_a_loop(spark):
    sizes = [(k, 0, 1000 if k % 7 else 3000 + k) for k in range(400)] + [(k, 1, 500) for k in range(300)]
    rows = spark.createDataFrame(sizes, "batch_id long, stream long, bytes long")
    found = {(r["stream"], r["batch_id"]): (r["ratio_milli"], r["lower"], r["upper"]) for r in batching.guarded_bands(rows, "stream", "batch_id", 85, 115).collect()}
    for stream in (0, 1):
        lo, hi, rest, seen = 85, 115, 0, []
        for k, _, n in [x for x in sizes if x[1] == stream]:
            seen = (seen + [n])[-128:]
            w = sorted(seen)
            p50, p95 = w[(len(w) - 1) // 2], w[(len(w) - 1) * 95 // 100]
            ratio = (p95 * 1000 + p50 // 2) // p50
            if len(seen) == 128:
                if rest:
                    rest -= 1
                else:
                    a, b = lo, hi
                    if ratio > 1250:
                        a = min(lo + 2, 95)
                        b = min(max(hi - 2, a + 10), 115)
                    elif ratio < 1100:
                        a = max(lo - 1, 85)
                        b = max(min(hi + 1, 115), a + 10)
                    if (a, b) != (lo, hi):
                        lo, hi, rest = a, b, 16
            assert found[stream, k] == (ratio, lo, hi)
    assert found[0, 399][1:] == (95, 105) and found[1, 299][1:] == (85, 115)


def test_plans_of_several_clips(spark):
    chunks = spark.createDataFrame([(1, k, k * 1000, k * 1000 + 1000, k * 100, k * 100 + 100, int(k % 4 == 0)) for k in range(10)], "media_id long, chunk_index long, start_ms long, end_ms long, start_byte long, end_byte long, keyframe int")
    clips = spark.createDataFrame([(1, 0, 500, 2500), (1, 1, 8500, 9500)], "media_id long, clip_id long, clip_start_ms long, clip_end_ms long")
    assert sorted(map(tuple, media.range_plan(chunks, clips, 3, 100).collect())) == [(1, 0, 0, 1, 0, 300, 300), (1, 1, 8000, 1, 800, 1000, 200)]


def test_leases(spark):
    queue = spark.createDataFrame([(0, 10, 1, 5, False, "a"), (10, 20, 0, 3, True, "b"), (20, 30, 1, 2, False, "a"), (30, 40, 0, 9, False, None)], "start_id long, end_id long, rank int, position long, requeued boolean, node string")
    assert sorted(map(tuple, ranges.pop_order(queue.drop("node")).collect()), key=repr) == sorted([(None, 10, 20, 0), (1, 20, 30, 0), (1, 0, 10, 1), (0, 30, 40, 0)], key=repr)
    dead = ranges.dead_nodes(spark.createDataFrame([("a", 5), ("a", 9), ("b", 90)], "node string, seen_ms long"), 100, 30)
    assert [r["node"] for r in dead.collect()] == ["a"]
    free = ranges.released(queue, dead)
    assert sorted(r["start_id"] for r in free.filter("requeued").collect()) == [0, 10, 20] and sorted(map(repr, ranges.released(free, dead).collect())) == sorted(map(repr, free.collect()))
    assert not ranges.drained(queue, queue) and ranges.drained(queue.limit(0), queue.limit(0))
    log = spark.createDataFrame([("H v1 abc",), ("C 0 10",)], "line string")
    assert ranges.replayed(log, "abc").count() == 1
    for lines, expected in ((log, "other"), (log.filter("line like 'C%'"), "abc")):
        with pytest.raises(ValueError):
            ranges.replayed(lines, expected)
    assert manifest.jump(spark.range(10).withColumnRenamed("id", "sample_id"), 5, 1).count() == 3
    with pytest.raises(ValueError, match="2 times"):
        manifest.strictly_increasing(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), "k")


TOKENS = [resume.DataToken("abc", 3, 10, 20), resume.VideoToken("abc", 1, 2, 4, 3, 8, 5, 50, 1, 4), resume.MixToken(1, 2, 30, ["x", "y=z"], [10, 20]), resume.LeaseToken("abc", 1, [(0, 5, 10), (10, 10, 20)], [(20, 30)])]


@pytest.mark.parametrize("token", TOKENS)
def test_tokens_round_trip(token):
    raw = token.encode()
    assert type(token).decode(raw) == token
    lines = raw.decode().splitlines()
    wrong = [b"", b"\xff", raw.replace(b"resume/1", b"resume/9"), raw.replace(b"kind=", b"kind=other"), raw + b"more=1\n", ("\n".join(lines[:-1]) + "\n").encode(), raw + lines[-1].encode() + b"\n", raw.replace(lines[2].encode(), lines[2].split("=")[0].encode() + b"=[]"), raw + b"line\n"]
    for bad in wrong:
        with pytest.raises(ValueError):
            type(token).decode(bad)


def test_resuming(spark):
    rows = spark.range(20).withColumnRenamed("id", "sample_id")
    token = TOKENS[0]
    assert resume.resumed(rows, token, "abc", 3, 20).count() == 10
    for now in (("x", 3, 20), ("abc", 4, 20), ("abc", 3, 21)):
        with pytest.raises(ValueError):
            resume.resumed(rows, token, *now)
    for bad in (resume.DataToken("a", 0, 5, 4), resume.VideoToken("a", 0, 0, 1, 1, 1, 9, 5, 0, 1), resume.VideoToken("a", 0, 0, 1, 1, 1, 1, 5, 2, 2), resume.MixToken(0, 0, 3, ["a"], [1]), resume.LeaseToken("a", 0, [(5, 4, 6)], [])):
        with pytest.raises(ValueError):
            bad.check()
    plan = spark.range(50).withColumnRenamed("id", "tick")
    left, other = resume.resumed_mix(plan, TOKENS[2], 1, 2, ["x", "new"])
    assert left.count() == 20 and other == 1
    with pytest.raises(ValueError):
        resume.resumed_mix(plan, TOKENS[2], 1, 3, ["x", "y=z"])
    with pytest.raises(ValueError):
        resume.resumed_clips(rows, TOKENS[1], manifest="other")
    made = spark.createDataFrame([(0, 10), (10, 20), (20, 30), (30, 40)], "start_id long, end_id long")
    token = TOKENS[3]
    mixed_up = resume.LeaseToken("abc", 1, token.open_ranges[::-1], token.done_ranges)
    assert sorted(map(tuple, resume.resumed_leases(made, [token, mixed_up], "abc", 1).collect())) == [(5, 10), (10, 20), (30, 40)]
    for args in (([token], "x", 1), ([token], "abc", 2), ([], "abc", 1), ([token, resume.LeaseToken("abc", 1, [], [])], "abc", 1), ([resume.LeaseToken("abc", 1, [(1, 2, 10)], [])], "abc", 1)):
        with pytest.raises(ValueError):
            resume.resumed_leases(made, *args)
    with pytest.raises(ValueError):
        resume.resumed_leases(made, [token], "abc", 1, issued=1)
    assert resume.numbers(" 1, 20,3 ") == [1, 20, 3] and resume.numbers(" ") == []
    for bad in ("1,", "a", "1 2", "-1"):
        with pytest.raises(ValueError):
            resume.numbers(bad)


def test_video_tables(spark, tmp_path):
    rows = [(k, f"f://{k % 3}", 0, k * 3, 4, "native", f"id{k}") for k in range(7)]
    clips = spark.createDataFrame(rows, "sample_id long, media_uri string, stream_id long, clip_start long, clip_len long, fps_policy string, clip_id string")
    path = tmp_path / "clips.tsv"
    lines = [r["line"] for r in video.text_of(clips, video.CLIP_COLUMNS).orderBy("sample_id").collect()]
    path.write_text(video.CLIPS_HEADER + "\n" + "\n".join(lines) + "\n")
    assert sorted(map(tuple, video.read_clips(spark, str(path)).collect())) == rows
    path.write_text("\n".join(lines))
    with pytest.raises(ValueError):
        video.read_clips(spark, str(path))
    path.write_text(video.CLIPS_HEADER + "\n" + lines[3] + "\n")
    with pytest.raises(ValueError):
        video.read_clips(spark, str(path))
    with pytest.raises(ValueError, match="7 clips"):
        video.bounded(clips, 6)
    assert video.bounded(clips, 7) is clips and video.index_hash(clips) == video.index_hash(clips.repartition(5)) != video.index_hash(clips.filter("sample_id < 6"))
    side = lambda k, a, b, c, d, key: f"1\tf://x\t0\th264\t1\t{k}\t{a}\t{b}\t{c}\t{d}\t{key}"
    good, bad = [side(0, 0, 10, 0, 100, 1), side(1, 10, 20, 100, 150, 0)], [[side(0, 0, 10, 0, 100, 0)], [side(0, 0, 10, 0, 100, 1), side(1, 5, 20, 100, 150, 0)], [side(0, 0, 10, 0, 100, 2)], [side(0, 0, 10, 100, 100, 1)]]
    (tmp_path / "r.tsv").write_text(video.RANGES_HEADER + "\n" + "\n".join(good))
    assert video.read_ranges(spark, str(tmp_path / "r.tsv")).count() == 2
    for k, wrong in enumerate(bad):
        (tmp_path / f"r{k}.tsv").write_text(video.RANGES_HEADER + "\n" + "\n".join(wrong))
        with pytest.raises(Exception, match=r".+"):
            video.read_ranges(spark, str(tmp_path / f"r{k}.tsv")).collect()


def test_video_contracts(spark):
    assert video.decode_contract(8, 8 * 3 * 100 + 5) == {"frames": 8, "height": 10, "width": 10, "channels": 3, "stride_t": 300, "stride_h": 30, "stride_w": 3, "stride_c": 1, "clip_bytes": 2400}
    assert video.decode_contract(4, 1)["height"] == 1
    with pytest.raises(ValueError):
        video.decode_contract(0, 10)
    contract = video.decode_contract(2, 24)
    clips = spark.createDataFrame([("a", b"x" * 30), ("b", b"y" * 24)], "clip_id string, payload binary")

    def picky(data):
        if data[:1] == b"x":
            raise ValueError("not mine")
        return data

    assert sorted(tuple(r) for r in video.decoded_clips(clips, [picky, lambda d: d], contract).collect()) == [("a", b"x" * 24, 1), ("b", b"y" * 24, 0)]
    with pytest.raises(Exception, match="short_media"):
        video.decoded_clips(spark.createDataFrame([("c", b"z")], clips.schema), [lambda d: d], contract).collect()
    assert video.next_inflight(1000, 0.5, 0.1, 10, 5000) == (1050, "calm") and video.next_inflight(1000, 0.95, 0.1, 10, 5000) == (850, "memory_high")
    assert video.next_inflight(1000, 0.5, 0.1, 10, 5000, wants_gpu=True) == (750, "no_gpu_reading") and video.next_inflight(1000, 0.5, 0.1, 10, 5000, 0.98, True) == (10, "gpu_full")
    assert video.next_inflight(1000, 0.5, 0.1, 10, 5000, 0.93, True) == (850, "gpu_high") and video.next_inflight(1000, 0.5, 0.1, 10, 5000, 0.3, True, 2) == (1000, "none") and video.next_inflight(1000, 0.5, 0.1, 10, 1020, 0.3, True, 3) == (1020, "calm")


def test_resolvers(spark):
    assert resolvers.hub_link("hf://o/n") == resolvers.HubLink("o/n") and resolvers.hub_link("hf://models/o/n/a/b?rev=v1") == resolvers.HubLink("o/n", "model", "v1", "a/b")
    for bad in ("hf://", "hf://only", "s3://o/n", "hf://datasets/only"):
        with pytest.raises(ValueError):
            resolvers.hub_link(bad)
    names = spark.createDataFrame([("b/2",), ("a.txt",), ("b/1",), ("b/2",), ("b/",), (" ",), ("bb/3",)], "name string")
    assert [r["location"][-3:] for r in resolvers.hub_files(spark, resolvers.hub_link("hf://o/n/b"), names).orderBy("sample_id").collect()] == ["b/1", "b/2"]
    with pytest.raises(ValueError):
        resolvers.hub_files(spark, resolvers.hub_link("hf://o/n/none"), names)
    records = [{"sample_id": 0, "location": "x"}, {"sample_id": 1, "location": "y", "byte_offset": 0, "byte_length": 5}]
    answers = [(503, b""), (200, json.dumps({"records": records}).encode())]
    rows = resolvers.remote(lambda _: answers.pop(0), sleep=lambda _: None)(spark, "q://x")
    key = manifest.content_hash(rows)
    body = "schema_version=0\n0\tx\t\t\t\n1\ty\t0\t5\t\n"
    again = resolvers.remote(lambda _: (200, json.dumps({"manifest_tsv": body, "manifest_hash": key}).encode()))(spark, "q://x")
    assert manifest.content_hash(again) == key
    for said in ({"records": records, "manifest_hash": "0"}, {}, {"records": [{"sample_id": 1, "location": "x"}]}, {"records": [{"sample_id": 0, "location": " "}]}):
        with pytest.raises(ValueError):
            resolvers.remote(lambda _, said=said: (200, json.dumps(said).encode()))(spark, "q://x")
    with pytest.raises(ValueError):
        resolvers.remote(lambda _: (404, b""))(spark, "q://x")
    known = resolvers.Registry()
    known.register("Q", lambda spark, link: link)
    assert known.manifest(spark, "q://x") == "q://x"
    with pytest.raises(ValueError):
        known.of("z://x")
    assert resolvers.Registry(lambda s, x: 1).of("z://x")(None, "") == 1


def test_text_manifests_are_checked(spark, tmp_path):
    def read(body, how):
        (tmp_path / "m.tsv").write_text(body)
        return [tuple(r) for r in how(spark, str(tmp_path / "m.tsv")).collect()]

    assert read("1\ty\t0\t5\th\tmore\n0\tx\n# c\n", tsv.read_lenient) == [(0, "x", None, None, None), (1, "y", 0, 5, "h")]
    for bad in ("0\tx\n2\ty\n", "0\tx\n0\ty\n", "0\t \n", "0\tx\t0\t0\n", "0\tx\t\t5\n"):
        with pytest.raises(Exception, match=r".+"):
            read(bad, tsv.read_lenient)
    for bad in ("0\tx\t\t\t\nschema_version=0\n", "schema_version=0\nschema_version=0\n0\tx\t\t\t\n", "schema_version=0\n0\tx\n", "schema_version=0\n1\tx\t\t\t\n", ""):
        with pytest.raises(Exception, match=r".+"):
            read(bad, tsv.read_canonical)


def test_one_of_many_indexes(spark, tmp_path):
    base = tmp_path / "shards" / "data"  # a folder that happens to lie below one of that name
    for k in range(3):
        (base / f"{k}.txt").parent.mkdir(parents=True, exist_ok=True)
        (base / f"{k}.txt").write_text("x" * (k + 1))
    store, calls, keys = snapshot.Store(spark, str(tmp_path / "store")), [], []

    def index(b):
        calls.append(1)
        time.sleep(1)
        return snapshot.folder(spark, b)

    every = [threading.Thread(target=lambda: keys.append(store.resolve(str(base), index, wait=60)[0])) for _ in range(3)]
    for t in every:
        t.start()
    for t in every:
        t.join()
    assert len(set(keys)) == 1 and len(keys) == 3 and len(calls) == 1
    assert store.length(keys[0]) == 3 and [r["byte_length"] for r in store.part(keys[0], 1, 3).orderBy("sample_id").collect()] == [2, 3]
    with pytest.raises(ValueError):
        store.part(keys[0], 1, 4)
    with pytest.raises(KeyError):
        store.get("0" * 64)
    assert store.lock("other", "me") and not store.lock("other", "you")
    with pytest.raises(TimeoutError):
        store.resolve("other", index, wait=0.3)
    held = store.root + "/locks/" + snapshot.intent_key("other")
    os.utime(held, (time.time() - 100, time.time() - 100))
    assert store.lock("other", "you")
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no file"):
        snapshot.folder(spark, str(tmp_path / "none"))
    assert [(r["sample_id"], bytes(r["payload"])) for r in snapshot.synthetic(spark, 2, 3).collect()] == [(0, b"xxx"), (1, b"xxx")]
    (base / "a").mkdir()
    (base / "a" / "deep.txt").write_text("y")
    assert snapshot.folder(spark, str(base), recursive=False).count() == 3 and snapshot.folder(spark, str(base)).count() == 4


def test_controller():
    p = control.PROFILES["balanced"]
    assert control.memory_limit("balanced", 10, 16 << 30) == 11 << 30 and control.memory_limit("safe", 5, 1 << 30, 7) == 12 and control.memory_limit("safe", 5, None, 7) == 12 + (1 << 30)
    c, now, said = control.Controller(p), control.Knobs(2, 64, 1), []
    for _ in range(45):
        now, why, press = c.tick(now, 0.2, 0.3, 0.3)
        said.append(why)
        assert p.rails_ahead[0] <= now.ahead <= p.rails_ahead[1] and p.rails_queue[0] <= now.queue <= p.rails_queue[1] and p.rails_leases[0] <= now.leases <= p.rails_leases[1] and 0 <= press <= 1
    assert said[:6] == ["probe_sampling"] * 5 + ["probe_ready"] and "probe_blend" in said and said[-1] == "increase" and now == control.Knobs(8, 128, 4)
    cut, why, _ = c.tick(now, 0.2, 0.98, 0.3)
    assert why == "hard_cut" and cut == control.Knobs(4, 89, 2)
    assert c.tick(cut, 0.0, 0.3, 0.3, net=0.9)[1] == "soft_cut_net"
    assert control.Controller(p).tick(control.Knobs(4, 64, 2), 0.1, 0.93, 0.3)[:2] == (control.Knobs(1, 16, 1), "probe_cut")
    told = control.human_stats({"samples": 50, "total": 100, "seconds": 10, "bytes": 10 << 20, "rss": 9 << 30, "limit": 10 << 30, "ratio_milli": 1300})
    assert "50 of 100 (50.0%)" in told and "5.0 samples/s, 1.00 MiB/s" in told and "HIGH" in told and "over 1.25" in told
    assert "starting" in control.human_stats({})


def test_stats(spark):
    batches = spark.createDataFrame([(2, 10), (3, 30)], "n long, bytes long")
    assert api.stats(batches, raw=True) == {"batches": 2, "samples": 5, "bytes": 40, "least": 10, "most": 30, "mean": 20}
    assert "5 of 10" in api.stats(batches, total=10, seconds=1)
    row = spark.createDataFrame([(1, 4), (0, 0)], "a long, b long").select(control.percent(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in row] == ["25.0%", "-"]
    d = control.durations(spark.createDataFrame([("x", 5), ("x", 8), ("y", 1)], "k string, ms long"), "k", "ms")
    assert sorted(map(tuple, d.collect())) == [("x", 2, 13, 8, 6), ("y", 1, 1, 1, 1)]


def test_progress_with_state(spark, tmp_path):
    reports = [(1, 1, 0, 0, 0, 100, 10), (1, 2, 0, 0, 0, 100, 5), (1, 3, 9, 0, 0, 100, 50), (1, 4, 0, 0, 0, 100, 500), (2, 1, 0, 0, 0, 10, 10)], [(1, 5, 0, 0, 0, 100, 20), (1, 6, 0, 0, 0, 100, 100)]
    for k, part in enumerate(reports):
        spark.createDataFrame(part, progress.REPORT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if k == 0 else 0)
    stream = spark.readStream.schema(progress.REPORT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = progress.accepted(stream).writeStream.outputMode("append").format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    found = {(r["lease_id"], r["seq"]): r["verdict"] for r in spark.table("verdicts").collect() if r["seq"] >= 0}
    assert found == {(1, 1): "accepted", (1, 2): "backwards", (1, 3): "not_owner", (1, 4): "out_of_range", (1, 5): "accepted", (1, 6): "completed", (2, 1): "completed"}
    progress.kept({"term": 3}, str(tmp_path / "s" / "state.json"))
    assert progress.found(str(tmp_path / "s" / "state.json")) == {"term": 3} and progress.found(str(tmp_path / "gone")) is None
    (tmp_path / "old.json").write_text('{"version": 0}')
    with pytest.raises(ValueError):
        progress.found(str(tmp_path / "old.json"))


def test_clips_of_a_link(spark, tmp_path):
    hints = ["video;frames=17;stream_id=0;codec=h264", "video;frames=25;stream_id=0;corrupt=true", "video;frames=2;stream_id=0;codec=h264", "video;frames=25;stream_id=0;codec=unsupported", "video;frames=25;codec=h264"]
    (tmp_path / "data/_meta").mkdir(parents=True)
    (tmp_path / "data/_meta/manifest.tsv").write_text("schema_version=0\n" + "".join(f"{k}\tv{k}.mp4\t\t\t{h}\n" for k, h in enumerate(hints)))
    clips, failures = api.video_clips(spark, str(tmp_path / "data"), 4, 2, root=str(tmp_path / "store"))
    assert clips.count() == 7 and {r[0]: r[1] for r in failures.collect()} == {"corrupt_media": 1, "short_media": 1, "unsupported_codec": 1, "missing_stream": 1}
    again, _ = api.video_clips(spark, str(tmp_path / "data"), 4, 2, root=str(tmp_path / "store"))
    assert video.index_hash(clips) == video.index_hash(again)
    with pytest.raises(ValueError):
        api.video_clips(spark, str(tmp_path / "data"), 4, 2, most=6, root=str(tmp_path / "store"))
