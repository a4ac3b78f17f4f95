"""Images: decode, resize, crop, flip, jitter, normalise, in this order, to rows of one shape."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.media import augmentation

OUT = 16 << 20  # bytes of pixels in one batch to Spark
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


@dataclass(frozen=True)
class Options:
    resize: tuple[int, int] | None = None
    crop: int | None = None
    flip: float = 0.0
    jitter: tuple[float, float, float] = (0.0, 0.0, 0.0)  # brightness, contrast, saturation
    hue: float = 0.0
    mean: tuple[float, float, float] | None = None
    std: tuple[float, float, float] | None = None

    def checked(self) -> Options:
        if self.resize and min(self.resize) <= 0:
            raise ValueError("sizes are over 0")
        if self.crop is not None and (self.crop <= 0 or (self.resize and self.crop > min(self.resize))):
            raise ValueError("a crop is over 0 and no larger than the image")
        if not 0 <= self.flip <= 1:
            raise ValueError("the chance of a flip is between 0 and 1")
        if min(self.jitter) < 0 or self.hue:
            raise ValueError("jitter is 0 or more, and there is none of hue")
        if (self.mean is None) != (self.std is None) or (self.std and min(self.std) <= 0):
            raise ValueError("mean and std come together, std over 0")
        return self


def preset(name: str | None, **given) -> Options:
    """imagenet (or standard): 256 down to a random 224, flipped half the time, jitter of 0.4, usual mean and std; what is given wins."""
    usual = {None: {}, "imagenet": {"resize": (256, 256), "crop": 224, "flip": 0.5, "jitter": (0.4, 0.4, 0.4), "mean": MEAN, "std": STD}}
    usual["standard"] = usual["imagenet"]
    if name not in usual:
        raise ValueError(f"no such preset: {name}")
    return Options(**(usual[name] | given)).checked()


def ppm_bytes(pixels: np.ndarray) -> bytes:
    """(height, width, 3) bytes as a PPM file."""
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def ppm(data: bytes) -> np.ndarray:
    """The pixels of a binary PPM or PGM file, as (height, width, 3)."""
    m = re.match(rb"(P[56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", data)
    if not m or int(m[4]) != 255:
        raise ValueError("not a PPM or PGM file of 8 bits")
    width, height, depth = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    body = np.frombuffer(data, np.uint8, offset=m.end())
    if len(body) < width * height * depth:
        raise ValueError("an image that ends too soon")
    return np.broadcast_to(body[: width * height * depth].reshape(height, width, depth), (height, width, 3))


def bmp(data: bytes) -> np.ndarray:
    """The pixels of an uncompressed BMP file of 24 or 32 bits."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP file")
    number = lambda a, n, signed=False: int.from_bytes(data[a : a + n], "little", signed=signed)
    start, width, height, bits = number(10, 4), number(18, 4, True), number(22, 4, True), number(28, 2)
    if bits not in (24, 32) or number(30, 4) not in (0, 3) or width <= 0 or not height:
        raise ValueError("a BMP of another kind")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, count=stride * abs(height), offset=start).reshape(abs(height), stride)
    rgb = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return rgb if height < 0 else rgb[::-1]


DECODERS: dict[bytes, Callable[[bytes], np.ndarray]] = {b"P6": ppm, b"P5": ppm, b"BM": bmp}


def decoded(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes by the file's own kind; what no decoder here knows goes to Pillow where it is installed."""
    if data[:2] in DECODERS:
        return DECODERS[data[:2]](data)
    try:
        import io

        from PIL import Image
    except ImportError as e:
        raise ValueError("no decoder for this kind of image") from e
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixels' centres in the middle of their squares."""
    if x.shape[:2] == (height, width):
        return x

    def places(n: int, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * of / n - 0.5, 0, of - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, of - 1), (at - low).astype(np.float32)

    (a, b, v), (c, d, h) = places(height, x.shape[0]), places(width, x.shape[1])
    x = x.astype(np.float32)
    rows = x[a] * (1 - v)[:, None, None] + x[b] * v[:, None, None]
    return np.rint(rows[:, c] * (1 - h)[None, :, None] + rows[:, d] * h[None, :, None]).astype(np.uint8)


def jittered(x: np.ndarray, brightness: float, contrast: float, saturation: float) -> np.ndarray:
    """(height, width, 3) floats in 0 .. 1: times brightness, about the mean of all, about each pixel's mean; cut to 0 .. 1 after each."""
    x = np.clip(x * np.float32(brightness), 0, 1)
    mean = x.mean(dtype=np.float64)
    x = np.clip((x - mean) * contrast + mean, 0, 1)
    grey = x.mean(2, keepdims=True)
    return np.clip((x - grey) * saturation + grey, 0, 1).astype(np.float32)


def prepared(x: np.ndarray, o: Options, choice: dict) -> np.ndarray:
    """One image as (3, height, width) floats by its choices (top, left, flip, brightness, contrast, saturation)."""
    if o.resize:
        x = resized(x, *o.resize)
    if o.crop is not None:
        x = x[choice["top"] : choice["top"] + o.crop, choice["left"] : choice["left"] + o.crop]
        if x.shape[:2] != (o.crop, o.crop):
            raise ValueError("an image is smaller than its crop")
    if choice["flip"]:
        x = x[:, ::-1]
    out = x.astype(np.float32) / np.float32(255)
    if any(o.jitter):
        out = jittered(out, *(choice[c] for c in ("brightness", "contrast", "saturation")))
    if o.mean is not None:
        out = (out - np.array(o.mean, np.float32)) / np.array(o.std, np.float32)
    return np.ascontiguousarray(out.transpose(2, 0, 1), dtype=np.float32)


def pixels(rows: DataFrame, o: Options, run: int, seed: int, epoch: int, payload: str = "payload", require_labels: bool = False) -> DataFrame:
    """(sample_id, label_id, height, width, pixels): 3 x height x width floats, channel by channel. The choices are the sample's own, the same on every machine.

    Images need a size of their own for a crop: with a crop comes a resize. Every image has a label or none has, if labels are required every one.
    """
    o.checked()
    if o.crop is not None and not o.resize:
        raise ValueError("a crop needs a resize, by which all images have one size")
    rows = rows.withColumn("label_id", F.col("label_id").cast("long") if "label_id" in rows.columns else F.lit(None).cast("long"))
    if require_labels:
        rows = rows.withColumn("label_id", F.when(F.col("label_id").isNull(), F.raise_error(F.concat(F.lit("an image without a label: "), F.col("sample_id").cast("string"))).cast("long")).otherwise(F.col("label_id")))
    height, width = o.resize or (0, 0)
    chosen = augmentation(rows, run, seed, epoch, height, width, o.crop or min(height, width), o.flip, o.jitter)
    both = rows.select("sample_id", "label_id", payload).join(chosen, "sample_id")

    def batch(rows: list[dict], made: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([r["sample_id"] for r in rows], pa.int64()), pa.array([r["label_id"] for r in rows], pa.int64()), pa.array([x.shape[1] for x in made], pa.int32()), pa.array([x.shape[2] for x in made], pa.int32())]
        values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(x.size for x in made)]), pa.int32()), pa.array(np.concatenate([x.ravel() for x in made])))
        return pa.RecordBatch.from_arrays([*columns, values], names=["sample_id", "label_id", "height", "width", "pixels"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some, out, held = [], [], 0
            for r in b.to_pylist():
                some.append(r)
                out.append(prepared(decoded(r[payload]), o, r))
                held += out[-1].nbytes
                if held >= OUT:
                    yield batch(some, out)
                    some, out, held = [], [], 0
            if some:
                yield batch(some, out)

    return both.mapInArrow(made, "sample_id long, label_id long, height int, width int, pixels array<float>")


def one_shape(rows: DataFrame, by: str = "batch_id") -> DataFrame:
    """(by, n, height, width) of batches; images of different shapes in one are an error."""
    shapes = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("height").alias("height"), F.min("width").alias("width"), F.max("height").alias("_h"), F.max("width").alias("_w"))
    differ = F.raise_error(F.concat(F.lit("images of a batch differ in shape: "), F.col(by).cast("string"))).cast("int")
    return shapes.select(by, "n", F.when((F.col("height") != F.col("_h")) | (F.col("width") != F.col("_w")), differ).otherwise(F.col("height")).alias("height"), "width")
