"""Command line: build cohorts and write the combined output.

    python -m claims_cohorts.cli --tables s3://bucket/claims [--cohorts A B] \\
        [--output_dir out/] [--combined_only] [--config cohorts.yaml] [--as_of 2024-01-01]

``--tables`` is a folder of ``<table>.parquet`` datasets; ``--catalog DB`` reads
catalog tables instead; ``--connection FILE`` a PostgreSQL database named in a YAML file
(its JDBC driver must be on the class path); ``--testdata DIR`` derives the claims
tables from the TPC-H-style test tables.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from claims_cohorts.plans.run import run_cohorts
from claims_cohorts.plans.spec import load_config
from claims_cohorts.session import ensure_checkpoint_dir
from claims_cohorts.sources.tables import check_schema, load_catalog, load_jdbc_yaml, load_parquet_dir
from claims_cohorts.sources.testdata import testdata_tables


def main(argv=None) -> dict:
    parser = argparse.ArgumentParser(description="Build cohorts and write per-cohort and combined outputs.")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables", help="folder of <table>.parquet datasets")
    source.add_argument("--catalog", help="catalog database holding the claims tables")
    source.add_argument("--connection", help="YAML file with a postgres section (host, port, database, user, password, schema)")
    source.add_argument("--testdata", help="TPC-H-style test tables to derive claims from")
    parser.add_argument("--config", help="cohort YAML (default: the shipped definitions)")
    parser.add_argument("--cohorts", nargs="*", help="cohorts to run (default: all, YAML order)")
    parser.add_argument("--output_dir", help="output folder (default: outputs/<timestamp>)")
    parser.add_argument("--combined_only", action="store_true", help="skip the per-cohort datasets and metadata files")
    parser.add_argument("--as_of", help="date for rolling date ranges (default: today)")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    if args.tables:
        tables = load_parquet_dir(spark, args.tables)
    elif args.catalog:
        tables = load_catalog(spark, args.catalog)
    elif args.connection:
        tables = load_jdbc_yaml(spark, args.connection)
    else:
        tables = testdata_tables(spark, args.testdata)
    check_schema(tables)
    cfg = load_config(args.config)
    meta = run_cohorts(spark, tables, cfg, args.output_dir, args.cohorts, args.combined_only, args.as_of)
    print(json.dumps(meta, indent=2, default=str))
    return meta


if __name__ == "__main__":
    main()
