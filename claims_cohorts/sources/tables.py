"""Claims tables: one DataFrame per table, from Parquet, a catalog or JDBC.

Nothing is loaded eagerly: every table is a lazy scan, so filters and projections
reach the source (Parquet ``PushedFilters`` / JDBC ``WHERE``).
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, fields, replace
from typing import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claims_cohorts.columns import CLAIM_ID, CLAIM_TYPE, DATE, MEMBER

log = logging.getLogger(__name__)

# FIXED VALUES — required tables and columns, and the optional table.
REQUIRED_SCHEMA: dict[str, list[str]] = {
    "claims_entries": ["claim_entry_id", "member_id_hash", "date_of_service", "claim_type"],
    "claims_diagnoses": ["claim_entry_id", "icd_code"],
    "members": ["member_id_hash"],
}
LOAD_TIME_TABLES = ["claims_entries", "claims_diagnoses", "claims_procedures", "claims_drugs", "members"]
OPTIONAL_SCHEMA: dict[str, list[str]] = {
    "claims_members_monthly_utilization": ["member_id_hash"],
}

TABLE_ATTR = {
    "claims_entries": "entries",
    "claims_diagnoses": "diagnoses",
    "claims_procedures": "procedures",
    "claims_drugs": "drugs",
    "members": "members",
    "eligibility": "eligibility",
    "claims_members_monthly_utilization": "utilization",
}


@dataclass(frozen=True)
class ClaimsTables:
    """The claims database as lazy DataFrames."""

    entries: DataFrame | None = None
    diagnoses: DataFrame | None = None
    procedures: DataFrame | None = None
    drugs: DataFrame | None = None
    members: DataFrame | None = None
    eligibility: DataFrame | None = None
    utilization: DataFrame | None = None

    def table(self, name: str) -> DataFrame | None:
        return getattr(self, TABLE_ATTR.get(name, name), None)

    def as_dict(self) -> dict[str, DataFrame]:
        out = {}
        for table, attr in TABLE_ATTR.items():
            df = getattr(self, attr)
            if df is not None:
                out[table] = df
        return out

    def with_tables(self, **kwargs) -> "ClaimsTables":
        return replace(self, **kwargs)

    @classmethod
    def from_dict(cls, tables: Mapping[str, DataFrame]) -> "ClaimsTables":
        kwargs = {}
        for name, df in tables.items():
            attr = TABLE_ATTR.get(name, name)
            if attr not in {f.name for f in fields(cls)}:
                raise KeyError(f"Unknown claims table: {name}")
            kwargs[attr] = df
        return cls(**kwargs)

    def entries_typed(self) -> DataFrame:
        """Entries with the service date at day grain (timestamps are cast to DATE)."""
        e = self.entries
        return e.select(CLAIM_ID, MEMBER, F.col(DATE).cast("date").alias(DATE), CLAIM_TYPE)


def load_parquet_dir(spark: SparkSession, path: str, names: list[str] | None = None) -> ClaimsTables:
    """Tables stored as ``{path}/{table}.parquet`` (or a directory per table).

    An optional table may be absent; a table that is there but can't be read raises.
    """
    tables = {}
    for name in names or list(TABLE_ATTR):
        full = f"{path.rstrip('/')}/{name}.parquet"
        try:
            tables[name] = spark.read.parquet(full)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            if name in LOAD_TIME_TABLES:
                raise RuntimeError(f"no dataset for required table {name}: {full}") from exc
            log.info("no dataset for optional table %s: %s", name, full)
    return ClaimsTables.from_dict(tables)


def load_catalog(spark: SparkSession, database: str = "default") -> ClaimsTables:
    """Tables registered in a catalog database (e.g. bucketed on claim_entry_id)."""
    if not spark.catalog.databaseExists(database):
        known = ", ".join(db.name for db in spark.catalog.listDatabases())
        raise RuntimeError(f"the catalog has no database {database!r}; it has: {known}")
    tables = {}
    for name in TABLE_ATTR:
        qualified = f"{database}.{name}"
        if spark.catalog.tableExists(qualified):
            tables[name] = spark.table(qualified)
        elif name in LOAD_TIME_TABLES:
            raise RuntimeError(f"the catalog has no required table {qualified}")
    return ClaimsTables.from_dict(tables)


#: Tables read over JDBC in ranges of ``claim_entry_id``.
FACT_TABLES = ("claims_entries", "claims_diagnoses", "claims_procedures", "claims_drugs")


def balanced_predicates(column: str, cuts: list[int]) -> list[str]:
    """Predicates of one read task each: the ranges between the cuts, and rows without an id."""
    cuts = sorted(set(cuts))
    if not cuts:
        return [f"{column} IS NULL OR {column} IS NOT NULL"]
    ranges = [f"{column} < {cuts[0]} OR {column} IS NULL"]
    ranges += [f"{column} >= {lo} AND {column} < {hi}" for lo, hi in zip(cuts, cuts[1:])]
    return [*ranges, f"{column} >= {cuts[-1]}"]


def load_jdbc(
    spark: SparkSession,
    url: str,
    schema: str = "public",
    properties: Mapping[str, str] | None = None,
    num_partitions: int = 16,
    bounds: Mapping[str, tuple[int, int]] | None = None,
    balanced: bool = False,
) -> ClaimsTables:
    """The five required tables over JDBC, and the optional one if the schema has it.

    Fact tables are read by ``num_partitions`` tasks, each a range of ``claim_entry_id``;
    ``bounds`` (table → lowest and highest id) is asked from the database where it is not
    given, one row per table. An empty fact table is one task.

    With ``balanced`` the ranges hold equally many rows: the database is asked for the quantiles of
    claim_entry_id (at most ``num_partitions`` numbers a table), which then bound the tasks'
    predicates. For ids with wide gaps, where ranges of equal width would leave most rows to a few
    tasks; it costs the database one pass over the ids.
    """

    def reader(table: str):
        r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
        for key, value in (properties or {}).items():
            r = r.option(key, value)
        return r

    listed = f"(SELECT table_name FROM information_schema.tables WHERE table_schema = '{schema}') listed"
    present = {row["table_name"] for row in reader(listed).load().collect()}
    missing = [name for name in LOAD_TIME_TABLES if name not in present]
    if missing:
        raise RuntimeError(f"schema {schema!r} has no table {', '.join(missing)}")
    tables = {}
    for name in [*LOAD_TIME_TABLES, *(t for t in OPTIONAL_SCHEMA if t in present)]:
        r = reader(f"{schema}.{name}")
        if name in FACT_TABLES and balanced:
            ranked = f"SELECT {CLAIM_ID} AS id, ntile({int(num_partitions)}) OVER (ORDER BY {CLAIM_ID}) AS part FROM {schema}.{name} WHERE {CLAIM_ID} IS NOT NULL"
            firsts = reader(f"(SELECT part, min(id) AS first_id FROM ({ranked}) ranked GROUP BY part) cuts").load()
            cuts = [row["first_id"] for row in firsts.collect() if row["part"] > 1]  # one row a task
            tables[name] = spark.read.jdbc(url, f"{schema}.{name}", predicates=balanced_predicates(CLAIM_ID, cuts), properties=dict(properties or {}))
            continue
        if name in FACT_TABLES:
            span = (bounds or {}).get(name)
            if span is None:
                ends = f"(SELECT min({CLAIM_ID}) AS lo, max({CLAIM_ID}) AS hi FROM {schema}.{name}) ends"
                row = reader(ends).load().first()
                span = (row["lo"], row["hi"])
            if span[0] is not None:
                r = r.option("partitionColumn", CLAIM_ID).option("lowerBound", str(span[0])).option("upperBound", str(span[1]))
                r = r.option("numPartitions", str(num_partitions))
        tables[name] = r.load()
    return ClaimsTables.from_dict(tables)


# FIXED VALUES — connection defaults of the YAML connection file.
JDBC_DEFAULTS = {"host": "localhost", "port": 5432, "schema": "public"}


def jdbc_settings(document: Mapping) -> dict:
    """(url, schema, properties) from a connection YAML document with a ``postgres`` section."""
    pg = dict((document or {}).get("postgres", {}) or {})
    host = pg.get("host", JDBC_DEFAULTS["host"])
    port = pg.get("port", JDBC_DEFAULTS["port"])
    url = f"jdbc:postgresql://{host}:{port}/{pg.get('database')}"
    props = {"driver": "org.postgresql.Driver"}
    if pg.get("user") is not None:
        props["user"] = str(pg["user"])
    if pg.get("password") is not None:
        props["password"] = str(pg["password"])
    return {"url": url, "schema": pg.get("schema", JDBC_DEFAULTS["schema"]), "properties": props}


def load_jdbc_yaml(
    spark: SparkSession,
    path: str,
    num_partitions: int = 16,
    bounds: Mapping[str, tuple[int, int]] | None = None,
    balanced: bool = False,
) -> ClaimsTables:
    """Claims tables over JDBC, connection read from a YAML file's ``postgres`` section
    (host, port, database, user, password, schema). The PostgreSQL JDBC driver must
    be on the cluster's classpath."""
    import yaml

    with open(path) as handle:
        settings = jdbc_settings(yaml.safe_load(handle))
    return load_jdbc(spark, settings["url"], settings["schema"], settings["properties"], num_partitions, bounds, balanced)


# --- validation of the input tables (driver-side, no job) ------------------------------


def _gaps(tables: ClaimsTables, wanted: Mapping[str, list[str]]) -> list[tuple[str, str | None]]:
    """(table, None) for each absent table, (table, column) for each absent column."""
    out: list[tuple[str, str | None]] = []
    for name, columns in wanted.items():
        df = tables.table(name)
        out += [(name, None)] if df is None else [(name, c) for c in columns if c not in df.columns]
    return out


def _told(gaps: list[tuple[str, str | None]], schema: str) -> list[str]:
    return [f"{schema}.{t} is absent" if c is None else f"{schema}.{t} lacks column {c}" for t, c in gaps]


def check_schema(tables: ClaimsTables, schema: str = "public") -> list[str]:
    """Raise ``RuntimeError`` with all gaps in the required tables; return, and log, those
    in the optional ones. Only the analyzed schemas are read, so no Spark job runs."""
    if required := _told(_gaps(tables, REQUIRED_SCHEMA), schema):
        raise RuntimeError("unusable claims tables: " + "; ".join(required))
    optional = _told(_gaps(tables, OPTIONAL_SCHEMA), schema)
    for text in optional:
        log.warning("optional: %s", text)
    return optional


def check_load_tables(tables: ClaimsTables, schema: str = "public") -> None:
    """All five load-time tables must exist."""
    if absent := _told([g for g in _gaps(tables, {t: [] for t in LOAD_TIME_TABLES})], schema):
        raise RuntimeError("claims tables to load: " + "; ".join(absent))


# FIXED VALUES — what the table profile asks of each required table.
PROFILE_REQUIRED: dict[str, list[str]] = {
    "claims_entries": ["claim_entry_id", "member_id_hash", "date_of_service", "claim_type"],
    "claims_diagnoses": ["claim_entry_id", "icd_code"],
    "claims_procedures": ["claim_entry_id"],
    "claims_drugs": ["claim_entry_id"],
    "members": ["member_id_hash"],
}


def table_profile(spark: SparkSession, tables: ClaimsTables) -> DataFrame:
    """Table discovery report: (table, required, present, missing_columns, n_columns, row_count).

    Row counts are computed by Spark as one aggregate per table, unioned into one
    small result (one row per table); no data reaches the driver.
    """
    rows = []
    profile = dict(PROFILE_REQUIRED)
    profile.update(OPTIONAL_SCHEMA)
    parts = []
    for name, required_cols in profile.items():
        df = tables.table(name)
        required = name in PROFILE_REQUIRED
        if df is None:
            rows.append((name, required, False, list(required_cols), 0))
            continue
        missing = [c for c in required_cols if c not in df.columns]
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"),
                F.lit(required).alias("required"),
                F.lit(True).alias("present"),
                F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"),
                F.lit(len(df.columns)).cast("long").alias("n_columns"),
                F.col("row_count").cast("long").alias("row_count"),
            )
        )
    if rows:
        absent = spark.createDataFrame(
            [(n, r, p, m, 0, None) for n, r, p, m, _ in rows],
            "table_name string, required boolean, present boolean, missing_columns array<string>, n_columns long, row_count long",
        )
        parts.append(absent)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
