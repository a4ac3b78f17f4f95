"""Byte transforms: a Python function of one sample, read as an expression, so that nothing leaves the JVM."""

from __future__ import annotations

import ast
import inspect
import textwrap
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_CAP = 16 << 20
HEAVY_MS = 8.0
DENIED = {"eval", "exec", "open", "compile", "globals", "locals", "vars", "input", "breakpoint"}


class Transform:
    """A function bytes -> bytes | None as a list of parts: literals, and None where the sample stands; parts is None if the function returns None."""

    def __init__(self, parts: list[bytes | None] | None):
        self.parts = parts

    @classmethod
    def of(cls, f: Callable) -> Transform:
        return cls.of_source(textwrap.dedent(inspect.getsource(f)))

    @classmethod
    def of_source(cls, source: str) -> Transform:
        """One positional argument, one return of the sample and byte literals added in any order, or of None."""
        found = [x for x in ast.parse(source).body if isinstance(x, ast.FunctionDef)]
        if len(found) != 1:
            raise ValueError("a transform is one function")
        f, a = found[0], found[0].args
        if len(a.args) != 1 or a.posonlyargs or a.kwonlyargs or a.vararg or a.kwarg or a.defaults:
            raise ValueError("a transform takes one positional argument")
        body = [x for x in f.body if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str))]
        if used := {n.id for n in ast.walk(f) if isinstance(n, ast.Name)} & DENIED:
            raise ValueError(f"a transform can't use {', '.join(sorted(used))}")
        if len(body) != 1 or not isinstance(body[0], ast.Return):
            raise ValueError("a transform is a single return")
        value = body[0].value
        if value is None or (isinstance(value, ast.Constant) and value.value is None):
            return cls(None)
        return cls(cls._parts(value, a.args[0].arg))

    @classmethod
    def _parts(cls, node: ast.expr, sample: str) -> list[bytes | None]:
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            return cls._parts(node.left, sample) + cls._parts(node.right, sample)
        if isinstance(node, ast.Constant) and isinstance(node.value, bytes):
            return [node.value]
        if isinstance(node, ast.Name) and node.id == sample:
            return [None]
        raise ValueError("a transform adds the sample and byte literals, nothing else")

    def column(self, payload: Column) -> Column:
        if self.parts is None:
            return F.lit(None).cast("binary")
        return F.concat(*(payload if p is None else F.lit(p) for p in self.parts)) if self.parts else F.lit(b"")

    def __call__(self, sample: bytes) -> bytes | None:
        return None if self.parts is None else b"".join(sample if p is None else p for p in self.parts)


def transform(f: Callable) -> Transform:
    """The decorator."""
    return Transform.of(f)


def applied(rows: DataFrame, f: Transform, payload: str = "payload", cap: int = SAMPLE_CAP) -> DataFrame:
    """rows with their payload transformed; rows for which the transform returns None go, the others keep all their columns. A result over the cap is an error."""
    if not isinstance(f, Transform):
        raise TypeError("decorate the function with @transform")
    if f.parts is None:
        return rows.limit(0)
    size = sum(len(p) for p in f.parts if p is not None) + f.parts.count(None) * F.octet_length(payload).cast("long")
    over = F.raise_error(F.concat(F.lit("a transformed sample is over the cap: "), size.cast("string"))).cast("binary")
    return rows.withColumn(payload, F.when(size > cap, over).otherwise(f.column(F.col(payload))))


def batches_within(batches: DataFrame, cap: int, payload: str = "payload") -> DataFrame:
    """batches, with an error for one whose payload is over what may be in flight."""
    over = F.raise_error(F.concat(F.lit("a transformed batch is over the cap: "), F.octet_length(payload).cast("string"))).cast("binary")
    return batches.withColumn(payload, F.when(F.octet_length(payload) > cap, over).otherwise(F.col(payload)))


def growth(before: int, after: int, old: float = 1.0) -> float:
    """The running ratio of bytes out to bytes in: four fifths what it was, one fifth what this batch did."""
    return 0.8 * old + 0.2 * (after / before) if before else old


def prefetch(ms_per_sample: float, usual: int) -> int:
    """A heavy transform is not prefetched."""
    return 1 if ms_per_sample >= HEAVY_MS else usual


def same_clips(before: DataFrame, after: DataFrame, size: int) -> DataFrame:
    """after, if it has before's clips: as many, the same ids, and `size` bytes each; else an error."""
    counts = before.select("clip_id").exceptAll(after.select("clip_id")).count() + after.select("clip_id").exceptAll(before.select("clip_id")).count()
    if counts:
        raise ValueError(f"a transform of clips keeps them all, and adds none: {counts} differ")
    wrong = F.raise_error(F.concat(F.lit("a transformed clip has another size: "), F.octet_length("payload").cast("string"))).cast("binary")
    return after.withColumn("payload", F.when(F.octet_length("payload") != size, wrong).otherwise(F.col("payload")))
