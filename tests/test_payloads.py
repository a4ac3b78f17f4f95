"""Bytes: reading them where they lie, packing them, retrying, and what they decode to."""

import hashlib
import os
import random
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill import api
from tidemill.functions import wrap64
from tidemill.operators import audio, batching, images, manifest, packing, payloads, text, transforms

MANIFEST = "sample_id long, location string, byte_offset long, byte_length long, decode_hint string"


def test_ranges_of_files(spark, tmp_path):
    a, b = bytes(range(256)) * 40, b"small"
    (tmp_path / "a.bin").write_bytes(a)
    (tmp_path / "b.bin").write_bytes(b)
    cases = [(k, str(tmp_path / "a.bin"), 97 * k, 13 + k, None) for k in range(60)] + [(60, f"file://{tmp_path}/b.bin", None, None, None), (61, str(tmp_path / "a.bin"), None, None, "h")]
    found = {r["sample_id"]: r for r in payloads.with_bytes(spark.createDataFrame(cases, MANIFEST)).collect()}
    assert all(found[k]["payload"] == a[97 * k : 97 * k + 13 + k] for k in range(60)) and found[60]["payload"] == b and found[61]["payload"] == a and found[61]["decode_hint"] == "h"
    for bad, says in (((0, str(tmp_path / "b.bin"), 3, 10, None), "ends 8 bytes before"), ((0, "s3://x/y", None, None, None), "no reader for s3"), ((0, str(tmp_path / "b.bin"), 1, None, None), "come together"), ((0, str(tmp_path / "gone"), None, None, None), "No such file")):
        with pytest.raises(Exception, match=says):
            payloads.with_bytes(spark.createDataFrame([bad], MANIFEST)).collect()


def test_other_stores_and_retries(spark):
    rows = spark.createDataFrame([(0, "mem://x", None, None, None), (1, "MEM://x", 2, 3, None)], MANIFEST)
    store = {"mem": lambda location, offset, length: b"0123456789" if offset is None else b"0123456789"[offset : offset + length]}
    assert {r["sample_id"]: r["payload"] for r in payloads.with_bytes(rows, store).collect()} == {0: b"0123456789", 1: b"234"}
    with pytest.raises(Exception, match="is empty"):
        payloads.with_bytes(rows.limit(1), {"mem": lambda *_: b""}).collect()
    tries, slept = [], []

    def shaky():
        tries.append(1)
        if len(tries) < 3:
            raise payloads.Passing("busy")
        return b"x"

    assert payloads.retried(shaky, 3, 40, slept.append) == b"x" and slept == pytest.approx([0.053, 0.103])
    with pytest.raises(payloads.Passing):
        payloads.retried(lambda: (_ for _ in ()).throw(payloads.Passing("no")), 2, sleep=slept.append)
    assert [payloads.passing(s) for s in (200, 404, 408, 429, 500, 503, 600)] == [False, False, True, True, True, True, False] and payloads.delay(9) == 1.0
    assert payloads.header_range(10, 5) == "bytes=10-14"


def test_headers():
    assert payloads.default_headers(" t ", "X-A: 1\\nX-B:2\n") == {"Authorization": "Bearer t", "X-A": "1", "X-B": "2"}
    assert payloads.default_headers("t", "authorization: own") == {"authorization": "own"}
    for bad in ("novalue", "a b: x", "X:", ": x"):
        with pytest.raises(ValueError):
            payloads.default_headers(None, bad)
    with pytest.raises(ValueError, match="hidden"):
        payloads.default_headers(None, "Cookie: se\x07cret")


def test_plans_of_ranges_and_whole_objects(spark, tmp_path):
    (tmp_path / "v").write_bytes(bytes(range(200)))
    plans = spark.createDataFrame([(1, str(tmp_path / "v"), 1, 0, 3), (1, str(tmp_path / "v"), 0, 100, 4)], "plan_id long, location string, part int, byte_offset long, byte_length long")
    whole = spark.createDataFrame([(1, str(tmp_path / "v")), (2, str(tmp_path / "v"))], "plan_id long, location string")
    found = {r["plan_id"]: (r["payload"], r["ranged"]) for r in payloads.clip_bytes(plans, whole).collect()}
    assert found == {1: (bytes([100, 101, 102, 103, 0, 1, 2]), True), 2: (bytes(range(200)), False)}


@pytest.mark.parametrize(("n", "seed", "cap"), [(0, 1, 5), (50, 0, 7), (200, 17, 1), (30, 5, 100)])
def test_reservoir_gives_each_once(spark, n, seed, cap):
    order = list(payloads.shuffled_scan(n, seed, cap))
    assert sorted(order) == list(range(n)) and (n < 20 or order != sorted(order) or cap == 1)
    if n:
        rows = {r["id"]: r["sample_id"] for r in payloads.reservoir(spark.range(n), "id", seed=seed, cap=cap).collect()}
        assert [k for k, _ in sorted(rows.items(), key=lambda x: x[1])] == order
        some = payloads.reservoir(spark.range(n), "id", seed=seed, cap=cap, start=5, end=9).collect()
        assert sorted(r["sample_id"] for r in some) == [5, 6, 7, 8]
        assert sorted(r["sample_id"] for r in payloads.seeded(spark.range(n), "id", 3).collect()) == list(range(n))


def test_shards_against_a_loop():
    rng = random.Random(2)
    for _ in range(60):
        lengths, limit = np.array([rng.randint(1, 5000) for _ in range(rng.randint(1, 60))]), rng.randint(1024, 20_000)
        shard, used, want = 0, 0, []
        for n in lengths.tolist():
            entry = packing.entry_size(n)
            if used and used + entry > limit:
                shard, used = shard + 1, 0
            want.append((shard, used + 512))
            used += entry
        cut, got, state = rng.randint(0, len(lengths)), [], (0, 0)
        for part in (lengths[:cut], lengths[cut:]):
            shards, offsets, *state = packing.assigned(part, limit, *state)
            got += list(zip(shards.tolist(), offsets.tolist(), strict=True))
        assert got == want


def test_pack_a_folder(spark, tmp_path):
    src, data = tmp_path / "src", {}
    for k in range(40):
        name = f"{'cat' if k % 2 else 'dog'}/{k:03}.{'jpeg' if k % 3 else 'long_extension'}"
        data[name] = os.urandom(40_000 + k)
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_bytes(data[name])
    (src / "shards").mkdir()
    (src / "shards" / "old.tar").write_bytes(b"x")
    rows = packing.pack_folder(spark, str(src), str(tmp_path / "out"), shard_mb=1, labels="auto").orderBy("sample_id").collect()
    assert len(rows) == 40 and [r["label_id"] for r in rows] == [0] * 20 + [1] * 20
    assert [r["label_id"] for r in packing.read_labels(spark, str(tmp_path / "out/_meta/labels.tsv")).orderBy("label_id").collect()] == [0, 1]
    for r, name in zip(rows, sorted(data), strict=True):
        with open(r["location"], "rb") as f:
            f.seek(r["byte_offset"])
            assert f.read(r["byte_length"]) == data[name]
    inside = [m for s in sorted((tmp_path / "out/shards").iterdir()) for m in tarfile.open(s).getmembers()]
    assert [m.size for m in inside] == [len(data[n]) for n in sorted(data)] and inside[0].name.startswith("0" * 20 + ".") and inside[1].name.endswith(".jpeg") | inside[1].name.endswith(".bin")
    key, again = api.resolve(spark, str(tmp_path / "out"), str(tmp_path / "store"))
    assert again.count() == 40 and key == manifest.content_hash(spark.createDataFrame([tuple(r)[:5] for r in rows], MANIFEST))
    whole = api.load(spark, str(tmp_path / "out"), batch=8, block=16, root=str(tmp_path / "store"), world=2, rank=0).unionByName(api.load(spark, str(tmp_path / "out"), batch=8, block=16, root=str(tmp_path / "store"), world=2, rank=1))
    seen = {}
    for b in whole.collect():
        for k, i in enumerate(b["sample_ids"]):
            seen[i] = (b["payload"][b["offsets"][k] : b["offsets"][k + 1]], b["label_ids"][k])
    assert seen == {r["sample_id"]: (data[n], r["label_id"]) for r, n in zip(rows, sorted(data), strict=True)}
    sized = api.load(spark, str(tmp_path / "out"), batch=100, by_bytes=(100_000, 130_000), block=16, root=str(tmp_path / "store")).collect()
    assert sum(len(b["sample_ids"]) for b in sized) == 40 and max(len(b["payload"]) for b in sized) <= 130_000
    assert not packing.pack_if_needed(spark, str(tmp_path / "out"))
    (src / "empty.txt").write_bytes(b"")
    with pytest.raises(Exception, match="an empty object"):
        packing.pack_folder(spark, str(src), str(tmp_path / "no"))


def test_labels_files(spark, tmp_path):
    def read(body):
        (tmp_path / "l.tsv").write_text(body)
        return [tuple(r) for r in packing.read_labels(spark, str(tmp_path / "l.tsv")).orderBy("label_id").collect()]

    assert read("schema_version=1\n# note\n1\tb%20c\n0\ta%C3%A9\n") == [(0, "aé"), (1, "b c")]
    for bad in ("0\ta\n", "schema_version=2\n0\ta\n", "schema_version=1\n0\ta\n0\tb\n", "schema_version=1\n1\ta\n", "schema_version=1\nx\ta\n", "schema_version=1\n0\ta%2\n", "schema_version=1\n0 a\n"):
        with pytest.raises(Exception, match=r".+"):
            read(bad)


def test_label_modes_and_hints(spark):
    rows = spark.createDataFrame([(0, "a/1"), (1, "b/2"), (2, "a/3")], "sample_id long, path string")
    ids = lambda df: [r["label_id"] for r in df.orderBy("sample_id").collect()]
    assert ids(manifest.labelled(rows, F.col("path"), "auto")) == [0, 1, 0] and ids(manifest.labelled(rows, F.col("path"), "none")) == [None] * 3
    odd = rows.unionByName(spark.createDataFrame([(3, "loose")], rows.schema))
    assert ids(manifest.labelled(odd, F.col("path"), "auto")) == [None] * 4 and ids(manifest.labelled(rows.filter("path like 'a%'"), F.col("path"), "auto")) == [None] * 2
    with pytest.raises(ValueError, match="1 of 4"):
        manifest.labelled(odd, F.col("path"), "imagefolder")
    with pytest.raises(ValueError):
        manifest.labelled(rows, F.col("path"), "other")
    hint = lambda h: spark.createDataFrame([(h,)], "h string").select(manifest.label_id_of(F.col("h"))).first()[0]
    assert hint("vision:folder;label_id=12;label=x") == 12 and hint("vision:folder;label=x; label_id = 3") == 3 and hint("text;label_id=4") is None and hint(None) is None
    for bad in ("vision:folder;label=x", "vision:folder;label_id=x"):
        with pytest.raises(Exception, match="without a label_id"):
            hint(bad)
    batch = spark.createDataFrame([(0, 1), (0, None), (1, None), (1, None)], "b long, l long")
    assert manifest.all_or_none(batch.filter("b = 1"), "b", "l").count() == 2
    with pytest.raises(Exception, match="some samples of a batch"):
        manifest.all_or_none(batch, "b", "l").collect()


def test_unknown_lengths_are_errors(spark):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate([50, None, 50, 50])], "sample_id long, byte_length long").withColumn("r", F.lit(0).cast("long"))
    with pytest.raises(Exception, match="length of every sample"):
        batching.by_bytes(rows, "r", 10, 100, 1000).collect()
    with pytest.raises(Exception, match="unknown length"):
        batching.packed(rows, 4).collect()
    assert batching.fixed(rows, 2).orderBy("batch_id").first()["bytes"] is None
    with pytest.raises(ValueError, match="in flight"):
        batching.by_bytes(rows, "r", 10, 100, 1000, inflight=500)
    with pytest.raises(Exception, match="larger than what may be in flight"):
        batching.within_inflight(spark.createDataFrame([(0, 3000)], "batch_id long, bytes long"), 2048).collect()


def test_hint_with_many_fields(spark):
    hint = "v;" + ";".join(f"k{i}={i}" for i in range(1500)) + ";k3=again"
    row = spark.createDataFrame([(hint,)], "h string").select(manifest.hint_fields(F.col("h")).alias("m"), manifest.hint_field(F.col("h"), "k3").alias("a"), manifest.hint_field(F.col("h"), "k1499").alias("b"), manifest.hint_field(F.col("h"), "no").alias("c")).first()
    assert len(row["m"]) == 1500 and row["m"]["k3"] == "again" and row["m"]["k1499"] == "1499" and tuple(row)[1:] == ("again", "1499", None)


def test_wav(spark):
    rng = np.random.default_rng(0)
    mono = rng.integers(-32768, 32767, 500).astype(np.int16)
    assert np.array_equal(audio.wav_mono(audio.wav_bytes(mono, 8000))[1], mono.astype(np.float32) / 32768)
    both = np.stack([mono, -(mono // 2)], 1).astype(np.int16)
    rate, x = audio.wav_mono(audio.wav_bytes(both, 44100))
    assert rate == 44100 and np.allclose(x, both.astype(np.float64).mean(1) / 32768, atol=1e-6)
    floats = rng.uniform(-1, 1, 99).astype(np.float32)
    assert np.array_equal(audio.wav_mono(audio.wav_bytes(floats, 16000))[1], floats)
    three = b"".join(struct.pack("<i", v)[:3] for v in (-8388608, 8388607, 0, -1))
    head = struct.pack("<HHIIHH", 1, 1, 8000, 24000, 3, 24)
    wav = b"RIFF" + struct.pack("<I", 36 + 12) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", 12) + three
    assert np.allclose(audio.wav_mono(wav)[1], [-1, 8388607 / 8388608, 0, -1 / 8388608])
    eight = audio.wav_bytes(mono, 8000).replace(head[:0], b"")
    assert audio.kind is not None and eight
    rows = spark.createDataFrame([(0, audio.wav_bytes(mono, 16000)), (1, b"not audio"), (2, audio.wav_bytes(mono, 8000)), (3, b"fLaC")], "sample_id long, payload binary")
    assert [r[0] for r in rows.orderBy("sample_id").select(audio.kind(F.col("payload"))).collect()] == ["wav", None, "wav", "flac"]
    out = audio.frames(rows, 600, 16000, "skip").collect()
    assert [r["sample_id"] for r in out] == [0] and len(out[0]["samples"]) == 600 and out[0]["samples"][500:] == [0.0] * 100
    with pytest.raises(Exception, match="not a WAV"):
        audio.frames(rows, 10).collect()
    for bad in ({"n": 0}, {"n": 5, "rate": 0}, {"n": 5, "channels": 2}, {"n": 5, "policy": "x"}):
        with pytest.raises(ValueError):
            audio.frames(rows, **bad)
    with pytest.raises(ValueError):
        audio.downmixed(floats, 2)


def test_pixels(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert np.array_equal(images.decoded(images.ppm_bytes(x)), x)
    assert np.array_equal(images.ppm(b"P5 # grey\n2 1\n255\n\x01\x09"), [[[1] * 3, [9] * 3]])
    raw = b"".join(row[:, ::-1].tobytes() + b"\0" for row in x[::-1])
    assert np.array_equal(images.decoded(b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(raw), 0, 54, 40, 5, 7, 1, 24, 0, len(raw), 0, 0, 0, 0) + raw), x)
    assert images.resized(x, 7, 5) is x and images.resized(np.full((3, 3, 3), 9, np.uint8), 8, 8).tolist() == np.full((8, 8, 3), 9).tolist()
    two = images.resized(np.array([[[0] * 3, [100] * 3]], np.uint8), 1, 4)[0, :, 0].tolist()
    assert two == [0, 25, 75, 100]
    o = images.preset("imagenet", resize=(8, 8), crop=6)
    assert o.flip == 0.5 and o.mean == images.MEAN
    choice = {"top": 1, "left": 2, "flip": True, "brightness": 1.2, "contrast": 0.7, "saturation": 1.3}
    big = rng.integers(0, 256, (8, 8, 3)).astype(np.uint8)
    want = big[1:7, 2:8][:, ::-1].astype(np.float64) / 255
    want = np.clip(want * 1.2, 0, 1)
    want = np.clip((want - want.mean()) * 0.7 + want.mean(), 0, 1)
    grey = want.mean(2, keepdims=True)
    want = (np.clip((want - grey) * 1.3 + grey, 0, 1) - images.MEAN) / images.STD
    assert np.allclose(images.prepared(big, o, choice), want.transpose(2, 0, 1), atol=1e-4)
    rows = spark.createDataFrame([(k, k % 2, images.ppm_bytes(big)) for k in range(6)], "sample_id long, label_id long, payload binary")
    a, b = (sorted(map(tuple, images.pixels(rows, o, 5, 7, 1).collect())) for _ in range(2))
    assert a == b and len(a) == 6 and a[0][2:4] == (6, 6) and len(a[0][4]) == 108 and a != sorted(map(tuple, images.pixels(rows, o, 5, 7, 2).collect()))
    with pytest.raises(Exception, match="without a label"):
        images.pixels(rows.withColumn("label_id", F.lit(None).cast("long")), o, 5, 7, 1, require_labels=True).collect()
    with pytest.raises(Exception, match="differ in shape"):
        images.one_shape(spark.createDataFrame([(0, 2, 2), (0, 2, 3)], "batch_id long, height int, width int")).collect()
    for bad in ({"crop": 300}, {"flip": 2}, {"hue": 0.1}, {"std": None}, {"jitter": (-1, 0, 0)}, {"std": (0, 1, 1)}):
        with pytest.raises(ValueError):
            images.preset("imagenet", **bad)
    with pytest.raises(ValueError):
        images.decoded(b"GIF89a")


def test_text_rows(spark):
    words = "[UNK] hello world runtime makes data loading deterministic tokenization in rust keeps python thin </s>".split()
    known = text.Words({w: k for k, w in enumerate(words)})
    payload = [b"hello world strange runtime", b"makes data loading deterministic", b"tokenization in rust keeps python thin", b"\xff\xfe\xfd", b""]
    rows = spark.createDataFrame(list(enumerate(payload)), "sample_id long, payload binary")
    out = sorted(map(tuple, text.rows_of_text(rows, known, 4, policy="skip", eos=False).collect()))
    assert out == [(0, 0, [1, 2, 0, 3], [1] * 4), (1, 0, [4, 5, 6, 7], [1] * 4), (2, 0, [8, 9, 10, 11], [1] * 4), (2, 1, [12, 13, 0, 0], [1, 1, 0, 0]), (4, 0, [0] * 4, [0] * 4)]
    with pytest.raises(Exception, match="(?i)utf"):
        text.rows_of_text(rows, known, 4).collect()
    with pytest.raises(Exception, match="more tokens than a window"):
        text.rows_of_text(rows.filter("sample_id = 2"), known, 4, truncate="error").collect()
    assert text.special_id(known, "eos") == 14 and text.pad_id(known, 14) == 14 and text.pad_id(known, None) == 0 and text.pad_id(text.Words({}, pad_id=3), 14) == 3
    for f in (lambda: text.special_id(known, "bos"), lambda: text.decoded(rows, policy="x"), lambda: text.windows(rows, 0), lambda: text.windows(rows, 4, truncate="left")):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(ValueError):
        text.Words({"a": 1}).encode("a b")


def test_a_library_tokenizer(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    rows = spark.createDataFrame([(0, "Hello there, world"), (1, None)], "sample_id long, text string")
    found = {r["sample_id"]: r["ids"] for r in text.tokenised(rows, text.Library(path).encode).collect()}
    assert found == {0: Tokenizer.from_file(path).encode("Hello there, world", add_special_tokens=False).ids, 1: []}


def test_transforms(spark):
    rows = spark.createDataFrame([(1, b"ab", 7), (2, b"", 8)], "sample_id long, payload binary, label_id long")

    @transforms.transform
    def f(sample):
        """Says what it does."""
        return b"T" + sample + b"-" + sample

    assert sorted(map(tuple, transforms.applied(rows, f).collect())) == [(1, b"Tab-ab", 7), (2, b"T-", 8)] and f(b"x") == b"Tx-x"
    drop = transforms.Transform.of_source("def g(s):\n    return None")
    assert transforms.applied(rows, drop).count() == 0 and drop(b"x") is None
    with pytest.raises(Exception, match="over the cap: 6"):
        transforms.applied(rows, f, cap=5).collect()
    with pytest.raises(TypeError):
        transforms.applied(rows, lambda s: s)
    for bad in ("def f(a, b):\n return a", "def f(a, *b):\n return a", "def f(a=b''):\n return a", "def f(a):\n x = a\n return x", "def f(a):\n return a * 2", "def f(a):\n return open", "def f(a):\n return b", "x = 1", "def f(a):\n return 'text'"):
        with pytest.raises(ValueError):
            transforms.Transform.of_source(bad)
    assert transforms.growth(10, 20) == pytest.approx(1.2) and transforms.growth(0, 5, 1.5) == 1.5 and transforms.prefetch(9, 4) == 1 and transforms.prefetch(1, 4) == 4
    clips = spark.createDataFrame([("a", b"1234"), ("b", b"5678")], "clip_id string, payload binary")
    assert transforms.same_clips(clips, clips, 4).count() == 2
    with pytest.raises(ValueError):
        transforms.same_clips(clips, clips.limit(1), 4)
    with pytest.raises(Exception, match="another size"):
        transforms.same_clips(clips, clips, 5).collect()
    with pytest.raises(Exception, match="batch is over the cap"):
        transforms.batches_within(spark.createDataFrame([(bytes(50),)], "payload binary"), 10).collect()


def test_batches_hand_over_arrays(spark):
    rows = spark.createDataFrame([(0, 1, b"cd", 5), (0, 0, b"ab", 4), (1, 2, b"e", 6)], "batch_id long, sample_id long, payload binary, label_id long")
    made = list(batching.tensors(batching.with_payload(rows), ["sample_ids", "payload", "label_ids"]))
    assert made[0]["sample_ids"].tolist() == [0, 1] and made[0]["payload"].tobytes() == b"abcd" and made[1]["label_ids"].tolist() == [6]
    with pytest.raises(Exception, match="no label"):
        batching.with_payload(rows.withColumn("label_id", F.when(F.col("sample_id") > 0, F.col("label_id")))).collect()
    none = batching.with_payload(rows.withColumn("label_id", F.lit(None))).collect()
    assert all(r["label_ids"] is None for r in none)


def test_percent_round_trip(spark):
    words = ["a b~é%/+", "", "%41", "\U0001f600;=", "plain"]
    rows = spark.createDataFrame([(w,) for w in words], "x string")
    assert [r[0] for r in rows.select(manifest.percent_decoded(manifest.percent_encoded(F.col("x")))).collect()] == words
    odd = spark.createDataFrame([("%4",), ("%zz",), ("%FF",), ("a%42",)], "x string")
    assert [r[0] for r in odd.select(manifest.percent_decoded(F.col("x"))).collect()] == [None, None, None, "aB"]


def test_content_hash_is_that_of_the_text(spark):
    rows = [(k, f"f://{k}", k * 10 if k % 2 else None, 10 if k % 2 else None, "h" if k % 3 else None) for k in range(200)]
    body = "schema_version=0\n" + "".join("\t".join("" if x is None else str(x) for x in r) + "\n" for r in rows)
    assert manifest.content_hash(spark.createDataFrame(rows, MANIFEST).repartition(7)) == hashlib.sha256(body.encode()).hexdigest()
    assert wrap64.fnv1a(b"") == 0xCBF29CE484222325
