"""Cohort configuration: YAML on the driver, turned into plain Python values.

The configuration is small (a few dozen cohorts); it never touches the data path
except as literals inside Column expressions.
"""

from __future__ import annotations

import copy
import logging
import os
from dataclasses import dataclass, field
from typing import Any

import yaml

log = logging.getLogger(__name__)

DEFAULT_CONFIG_PATH = os.path.join(os.path.dirname(os.path.dirname(__file__)), "config", "cohorts.yaml")


@dataclass(frozen=True)
class CohortConfig:
    """Parsed cohort YAML: ``cohorts`` keeps the YAML order."""

    cohorts: dict[str, dict[str, Any]]
    raw: dict[str, Any] = field(repr=False, default_factory=dict)

    def names(self) -> list[str]:
        return list(self.cohorts)

    def cohort(self, name: str) -> dict[str, Any]:
        """The cohort's mapping; unknown names raise ``KeyError``."""
        return self.cohorts[name]

    def inclusion(self, name: str) -> dict[str, Any]:
        return self.cohorts[name]["inclusion"]

    def exclusion(self, name: str) -> dict[str, Any]:
        return self.cohorts[name].get("exclusion") or {}

    def tags(self, name: str) -> dict[str, list[str]]:
        return self.cohorts[name].get("tags") or {}


def parse_config(document: dict[str, Any]) -> CohortConfig:
    """Validate a parsed YAML document: every cohort needs an ``inclusion`` mapping."""
    cohorts = (document or {}).get("cohorts", {}) or {}
    for name, cfg in cohorts.items():
        if not isinstance(cfg, dict) or "inclusion" not in cfg:
            raise ValueError(f"cohort {name!r} has no inclusion mapping")
    return CohortConfig(cohorts=copy.deepcopy(cohorts), raw=document)


def load_config(path: str | None = None) -> CohortConfig:
    """Read the cohort YAML (``yaml.safe_load``: anchors, aliases and merge keys)."""
    with open(path or DEFAULT_CONFIG_PATH, "r") as handle:
        return parse_config(yaml.safe_load(handle))


def config_from_text(text: str) -> CohortConfig:
    return parse_config(yaml.safe_load(text))


# --- default-path parameters -------------------------------------------------------


@dataclass(frozen=True)
class DefaultPathSpec:
    """The knobs of the default cohort path, read the way the original cohort logic reads them."""

    name: str
    icd_codes: tuple[str, ...]
    claim_types: tuple[str, ...] | None
    date_range_years: int | None
    min_days: int
    min_claims: int
    within_days: int | None
    procedure_codes: tuple[str, ...] | None  # None: no procedure flag column
    medication_codes: tuple[str, ...] | None  # None: no drug flag column
    require_both: bool
    subtypes: tuple[str, ...] | None
    subtype_window: int | None
    organic_gi: tuple[str, ...] | None
    organic_window: int | None
    symptom_codes: tuple[str, ...] | None
    symptom_window: int | None

    @property
    def support_mode(self) -> str:
        """How procedure / drug support filters the index rows.

        ``and``: both filters; ``or``: union of both; ``proc``/``drug``: one filter;
        ``none``: no filter (this includes OR mode with only procedure codes).
        """
        has_proc = bool(self.procedure_codes)
        has_drug = bool(self.medication_codes)
        if self.require_both:
            if has_proc and has_drug:
                return "and"
            if has_proc:
                return "proc"
            if has_drug:
                return "drug"
            return "none"
        if has_drug:
            return "or" if has_proc else "drug"
        return "none"


def default_path_spec(config: CohortConfig, name: str) -> DefaultPathSpec:
    """Read one cohort's default-path knobs; missing required keys raise ``KeyError``."""
    cohort = config.cohort(name)
    inc = cohort["inclusion"]
    exc = cohort.get("exclusion") or {}
    icd_codes = tuple(inc["icd_codes"])
    if "min_days_between_claims" not in inc:
        log.warning("cohort %s sets no gap between claims: any two claims make a pair", name)
    min_days = int(inc.get("min_days_between_claims", 0))
    min_claims = int(inc["min_claims"])
    within = inc.get("within_months")
    proc = tuple(inc.get("procedure_codes") or ()) if inc.get("allow_procedure") and "procedure_codes" in inc else None
    drug = tuple(inc.get("medication_codes") or ()) if inc.get("allow_medication") and "medication_codes" in inc else None
    both_sub = "subtypes" in exc and "subtype_window_days" in exc
    both_org = "organic_gi" in exc and "organic_gi_window_days" in exc
    both_sym = "symptom_codes" in inc and "symptom_window_days" in inc
    return DefaultPathSpec(
        name=name,
        icd_codes=icd_codes,
        claim_types=tuple(inc["claim_types"]) if "claim_types" in inc else None,
        date_range_years=int(inc["date_range_years"]) if "date_range_years" in inc else None,
        min_days=min_days,
        min_claims=min_claims,
        within_days=int(within) * 30 if within is not None else None,
        procedure_codes=proc,
        medication_codes=drug,
        require_both=bool(inc.get("require_both_procedure_and_medication", True)),
        subtypes=tuple(exc["subtypes"]) if both_sub else None,
        subtype_window=int(exc["subtype_window_days"]) if both_sub else None,
        organic_gi=tuple(exc["organic_gi"]) if both_org else None,
        organic_window=int(exc["organic_gi_window_days"]) if both_org else None,
        symptom_codes=tuple(inc["symptom_codes"]) if both_sym else None,
        symptom_window=int(inc["symptom_window_days"]) if both_sym else None,
    )
