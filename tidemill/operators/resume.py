"""Resume tokens: where a delivery stopped, as text that is checked when it comes back."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = "tidemill-resume/1"


class Token:
    """Encodes to MAGIC, the kind, and a line for each field; decoding takes just that."""

    kind = ""

    def encode(self) -> bytes:
        parts = [MAGIC, f"kind={self.kind}", *(f"{k}={json.dumps(v)}" for k, v in asdict(self).items())]
        return ("\n".join(parts) + "\n").encode()

    @classmethod
    def decode(cls, raw: bytes):
        try:
            head, *lines = raw.decode().splitlines()
        except (UnicodeDecodeError, ValueError) as e:
            raise ValueError("not a token") from e
        if head != MAGIC:
            raise ValueError("a token of another format")
        found: dict[str, str] = {}
        for line in filter(str.strip, lines):
            k, eq, v = line.partition("=")
            if not eq or k.strip() in found:
                raise ValueError(f"not a line of a token: {line}")
            found[k.strip()] = v.strip()
        if found.pop("kind", None) != cls.kind:
            raise ValueError(f"not a token of {cls.kind}")
        names = {f.name: f.type for f in fields(cls)}
        if set(found) != set(names):
            raise ValueError(f"a token of {cls.kind} has {', '.join(names)}")
        try:
            values = {k: json.loads(v) for k, v in found.items()}
        except json.JSONDecodeError as e:
            raise ValueError("a value that can't be read") from e
        for k, v in values.items():
            if names[k] == "int" and (type(v) is not int or v < 0) or names[k] == "str" and not isinstance(v, str):
                raise ValueError(f"not a value of {k}: {v!r}")
        token = cls(**{k: [tuple(x) for x in v] if names[k].startswith("list[tuple") else v for k, v in values.items()})
        token.check()
        return token

    def check(self) -> None:
        pass


@dataclass(frozen=True)
class DataToken(Token):
    manifest: str
    epoch: int
    next_id: int
    end_id: int
    schema: int = 0
    kind = "data"

    def check(self) -> None:
        if self.next_id > self.end_id:
            raise ValueError("a token beyond its end")


@dataclass(frozen=True)
class VideoToken(Token):
    manifest: str
    seed: int
    epoch: int
    clip: int
    stride: int
    fps: int
    next_clip: int
    clips: int
    rank: int
    world: int
    kind = "video"

    def check(self) -> None:
        if self.next_clip > self.clips or self.world < 1 or self.rank >= self.world:
            raise ValueError("a token beyond its clips or its ranks")


@dataclass(frozen=True)
class MixToken(Token):
    seed: int
    epoch: int
    tick: int
    sources: list[str]
    emitted: list[int]
    kind = "mix"

    def check(self) -> None:
        if len(self.sources) != len(self.emitted) or not self.sources:
            raise ValueError("a token of a mix has as many counts as sources")
        if sum(self.emitted) != self.tick:
            raise ValueError("a token whose counts aren't its ticks")


@dataclass(frozen=True)
class LeaseToken(Token):
    """Ranges (start_id, cursor, end_id) that were out when a distributed delivery stopped, and those that were complete."""

    manifest: str
    epoch: int
    open_ranges: list[tuple[int, int, int]]
    done_ranges: list[tuple[int, int]]
    kind = "leases"

    def check(self) -> None:
        if any(len(r) != 3 or not r[0] <= r[1] <= r[2] for r in self.open_ranges) or any(len(r) != 2 or r[0] >= r[1] for r in self.done_ranges):
            raise ValueError("a token with a range that is none")

    def fingerprint(self) -> str:
        """The same for tokens of one stop, whatever order their ranges are in."""
        import hashlib

        return hashlib.sha256(repr((self.manifest, self.epoch, sorted(self.open_ranges), sorted(self.done_ranges))).encode()).hexdigest()


def resumed(rows: DataFrame, token: DataToken, manifest: str, epoch: int, end_id: int, schema: int = 0) -> DataFrame:
    """The rows that are still to come. A token of another manifest, epoch, schema or end is an error."""
    wrong = [n for n, a, b in (("manifest", token.manifest, manifest), ("epoch", token.epoch, epoch), ("end", token.end_id, end_id), ("schema", token.schema, schema)) if a != b]
    if wrong:
        raise ValueError(f"a token of another {' and '.join(wrong)}")
    return rows.filter((F.col("sample_id") >= token.next_id) & (F.col("sample_id") < token.end_id))


def resumed_clips(clips: DataFrame, token: VideoToken, **now) -> DataFrame:
    """The clips of a rank that are still to come; now: what the token's fields (but next_clip) are this time, which must be the same."""
    wrong = [k for k, v in now.items() if getattr(token, k) != v]
    if wrong:
        raise ValueError(f"a token of another {', '.join(wrong)}")
    mine = clips.filter(F.pmod("sample_id", F.lit(token.world)) == token.rank)
    return mine.filter(F.expr(f"sample_id div {token.world}") >= token.next_clip)


def resumed_mix(plan: DataFrame, token: MixToken, seed: int, epoch: int, sources: list[str]) -> tuple[DataFrame, int]:
    """(the ticks still to come, how many sources aren't those of the token). Another seed, epoch or number of sources is an error; another source is counted and goes on as well as it can."""
    if (token.seed, token.epoch, len(token.sources)) != (seed, epoch, len(sources)):
        raise ValueError("a token of another seed, epoch or number of sources")
    return plan.filter(F.col("tick") >= token.tick), sum(a != b for a, b in zip(token.sources, sources, strict=True))


def resumed_leases(ranges: DataFrame, tokens: list[LeaseToken], manifest: str, epoch: int, issued: int = 0) -> DataFrame:
    """(start_id, end_id): what is left of the ranges. Only before any lease is given out; all tokens are of one stop, and each of their ranges is one of these, or it is an error."""
    if issued:
        raise ValueError("leases have been given out")
    if not tokens or len({t.fingerprint() for t in tokens}) != 1:
        raise ValueError("tokens of one stop, one or more")
    token = tokens[0]
    if (token.manifest, token.epoch) != (manifest, epoch):
        raise ValueError("a token of another manifest or epoch")
    spark = ranges.sparkSession
    said = spark.createDataFrame([(a, c, e) for a, c, e in token.open_ranges] + [(a, e, e) for a, e in token.done_ranges], "start_id long, cursor long, e long")
    if missing := said.join(ranges, (ranges["start_id"] == said["start_id"]) & (F.col("end_id") == F.col("e")), "left_anti").limit(3).collect():
        raise ValueError(f"ranges that aren't there: {[(r['start_id'], r['e']) for r in missing]}")
    joined = ranges.join(said.select(F.col("start_id").alias("s"), "cursor"), F.col("start_id") == F.col("s"), "left")
    return joined.select(F.greatest("start_id", F.coalesce("cursor", "start_id")).alias("start_id"), "end_id").filter("start_id < end_id")


def numbers(text: str) -> list[int]:
    """A list parted by commas; white space around numbers is nothing, an empty text no number."""
    parts = [x.strip() for x in text.split(",")] if text.strip() else []
    if any(not x.isascii() or not x.isdigit() for x in parts):
        raise ValueError(f"not a list of numbers: {text!r}")
    return [int(x) for x in parts]
