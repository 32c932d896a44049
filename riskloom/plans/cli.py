"""Command line: ``python -m riskloom.plans.cli --providers ... --claims ... --exclusions ... --output-dir ... --salt ...``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from riskloom.config import Settings
from riskloom.plans import pipeline
from riskloom.sources import tables


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Score providers for risk.")
    for name in ("providers", "claims", "exclusions"):
        p.add_argument(f"--{name}", required=True)
    for name in ("ownership", "bank-accounts"):
        p.add_argument(f"--{name}")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--capacity", type=int, default=50)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--trees", type=int)
    p.add_argument("--format", default="csv", choices=("csv", "parquet"))
    p.add_argument("--salt", default=os.environ.get("HASH_SALT"), help="or the environment's HASH_SALT")
    a = p.parse_args(args)
    if not a.salt:
        p.error("a salt is needed")
    spark = SparkSession.builder.appName("riskloom").getOrCreate()
    try:
        result = pipeline.run(
            tables.load_providers(spark, a.providers, a.salt, a.format),
            tables.load_claims(spark, a.claims, a.salt, a.format),
            tables.load_exclusions(spark, a.exclusions, a.format),
            tables.load_ownership(spark, a.ownership, a.salt, a.format) if a.ownership else None,
            tables.load_bank_accounts(spark, a.bank_accounts, a.format) if a.bank_accounts else None,
            Settings(investigator_capacity=a.capacity, random_seed=a.seed),
            a.trees,
        )
        pipeline.save(result, a.output_dir)
        print(result.metrics.first().asDict())
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
