"""claims_cohorts: patient cohorts from medical claims, built as Spark DataFrame plans.

Every operator is a pure ``DataFrame -> DataFrame`` function; the only driver-side
work is reading the cohort YAML and composing Column expressions from it.
"""

from claims_cohorts.plans.spec import load_config, CohortConfig
from claims_cohorts.sources.tables import ClaimsTables
from claims_cohorts.plans.cohorts import build_cohort, build_cohorts, cohort_logic, COHORT_LOGIC_REGISTRY
from claims_cohorts.plans.run import run_cohorts
from claims_cohorts.builder import CohortBuilder

__all__ = [
    "load_config",
    "CohortConfig",
    "ClaimsTables",
    "build_cohort",
    "build_cohorts",
    "cohort_logic",
    "COHORT_LOGIC_REGISTRY",
    "run_cohorts",
    "CohortBuilder",
]
