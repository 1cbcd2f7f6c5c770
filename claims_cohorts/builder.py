"""``CohortBuilder``: the tables, the configuration and the as-of date in one object.

Construction validates the configuration (every cohort needs ``inclusion``) and the
tables (required tables and columns); the methods return lazy DataFrames or run the
output job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claims_cohorts.plans.cohorts import CohortContext, build_cohort, build_cohorts, inclusion_claims_advanced
from claims_cohorts.plans.run import run_cohorts
from claims_cohorts.plans.spec import CohortConfig, load_config
from claims_cohorts.sources.tables import ClaimsTables, check_schema


class CohortBuilder:
    def __init__(self, tables: ClaimsTables, config: CohortConfig | str | None = None, as_of=None, schema: str = "public"):
        self.tables = tables
        self.config = config if isinstance(config, CohortConfig) else load_config(config)
        self.as_of = as_of
        self.warnings = check_schema(tables, schema)

    @property
    def context(self) -> CohortContext:
        return CohortContext(self.tables, self.config, self.as_of)

    def build_cohort(self, name: str) -> DataFrame:
        return build_cohort(self.tables, self.config, name, self.as_of)

    def build_cohorts(self, names=None) -> DataFrame:
        return build_cohorts(self.tables, self.config, names, self.as_of)

    def inclusion_claims(self, name: str) -> DataFrame:
        return inclusion_claims_advanced(self.tables, self.config.inclusion(name), self.as_of)

    def run(self, spark: SparkSession, output_dir: str | None = None, cohorts=None, combined_only: bool = False) -> dict:
        return run_cohorts(spark, self.tables, self.config, output_dir, cohorts, combined_only, self.as_of)
