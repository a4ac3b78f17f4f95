"""python -m tidemill pack IN OUT [--shard-mb N] [--labels none|imagefolder|auto] [--require-labels] | resolve LINK [--store FOLDER]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemill import api


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidemill", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    packer = sub.add_parser("pack")
    packer.add_argument("source")
    packer.add_argument("out")
    packer.add_argument("--shard-mb", type=int, default=512)
    packer.add_argument("--labels", default="auto", choices=["none", "off", "false", "0", "imagefolder", "auto"])
    packer.add_argument("--require-labels", action="store_true")
    resolver = sub.add_parser("resolve")
    resolver.add_argument("link")
    resolver.add_argument("--store")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tidemill").getOrCreate()
    if a.what == "pack":
        rows = api.pack_folder(spark, a.source, a.out, shard_mb=a.shard_mb, labels=a.labels, require_labels=a.require_labels)
        print(f"{rows.count()} samples in {a.out}")
    else:
        print(api.resolve(spark, a.link, a.store)[0])


if __name__ == "__main__":
    main()
