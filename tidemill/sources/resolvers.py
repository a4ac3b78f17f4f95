"""From a link to a manifest: resolvers by scheme, hubs of repositories, and services that resolve for others."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import manifest
from tidemill.operators.payloads import Passing, passing, retried
from tidemill.sources.tsv import SCHEMA, canonical_rows

KINDS = {"datasets": "dataset", "models": "model", "spaces": "space"}
Resolver = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class HubLink:
    repository: str
    kind: str = "dataset"
    revision: str = "main"
    prefix: str | None = None


def hub_link(text: str) -> HubLink:
    """hf://[datasets|models|spaces/]owner/name[/prefix][?rev=revision]."""
    m = re.fullmatch(r"hf://([^?]*)(?:\?(.*))?", text.strip())
    if not m:
        raise ValueError(f"not a hub link: {text}")
    parts = [p for p in m[1].split("/") if p.strip()]
    kind = KINDS[parts.pop(0)] if parts and parts[0] in KINDS else "dataset"
    if len(parts) < 2:
        raise ValueError(f"a hub link has an owner and a name: {text}")
    asked = dict(x.partition("=")[::2] for x in (m[2] or "").split("&") if x)
    revision = asked.get("rev") or asked.get("revision") or "main"
    return HubLink("/".join(parts[:2]), kind, revision, "/".join(parts[2:]) or None)


def hub_files(spark: SparkSession, link: HubLink, names: DataFrame, url: Callable[[str], str] | None = None) -> DataFrame:
    """The manifest of a repository's files (name), sorted, each once, below the link's prefix; none is an error."""
    kept = names.select(F.col("name")).filter("trim(name) <> '' and not endswith(name, '/')").distinct()
    if link.prefix:
        kept = kept.filter((F.col("name") == link.prefix) | F.col("name").startswith(f"{link.prefix}/"))
    base = url("") if url else f"hf://{link.kind}s/{link.repository}@{link.revision}/"
    ids = manifest.with_dense_ids(kept, "name")
    if ids.isEmpty():
        raise ValueError(f"no file below {link.repository}/{link.prefix or ''}")
    return ids.select("sample_id", F.concat(F.lit(base), "name").alias("location"), *(F.lit(None).cast(t).alias(c) for c, t in (("byte_offset", "long"), ("byte_length", "long"), ("decode_hint", "string"))))


def remote(ask: Callable[[str], tuple[int, bytes]], attempts: int = 3, sleep=None) -> Resolver:
    """A resolver that a service answers: ask(link) gives (status, body), the body JSON with manifest_tsv or records, and a hash that must be that of what it lists."""

    def one(link: str) -> bytes:
        status, body = ask(link)
        if passing(status):
            raise Passing(f"status {status}")
        if status != 200:
            raise ValueError(f"status {status} for {link}")
        return body

    def resolve(spark: SparkSession, link: str) -> DataFrame:
        said = json.loads(retried(lambda: one(link), attempts, **({"sleep": sleep} if sleep else {})))
        if ("manifest_tsv" in said) == ("records" in said):
            raise ValueError("an answer has manifest_tsv or records")
        if "records" in said:
            rows = spark.createDataFrame([tuple(r.get(c) for c in ("sample_id", "location", "byte_offset", "byte_length", "decode_hint")) for r in said["records"]], SCHEMA)
        else:
            lines = said["manifest_tsv"].split("\n")
            rows = canonical_rows(spark.createDataFrame([(x,) for x in lines], "value string"), lines[0])
        rows = manifest.checked(rows)
        if said.get("manifest_hash") and manifest.content_hash(rows) != said["manifest_hash"]:
            raise ValueError("the answer's hash isn't that of its manifest")
        return rows

    return resolve


class Registry:
    """Resolvers by scheme in lower case; what has none goes to the fallback, and without one is an error."""

    def __init__(self, fallback: Resolver | None = None):
        self.known: dict[str, Resolver] = {}
        self.fallback = fallback

    def register(self, scheme: str, resolver: Resolver) -> None:
        self.known[scheme.lower()] = resolver

    def of(self, link: str) -> Resolver:
        scheme, there, _ = link.strip().partition("://")
        scheme = scheme.lower() if there else "file"
        found = self.known.get(scheme, self.fallback)
        if found is None:
            raise ValueError(f"no resolver for {scheme}")
        return found

    def manifest(self, spark: SparkSession, link: str) -> DataFrame:
        return self.of(link)(spark, link)
