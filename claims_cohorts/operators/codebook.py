"""Rules matched against the distinct codes of the data, then joined to the lines.

Configured code patterns are matched once per distinct diagnosis code (a few thousand to
~100k values), not once per claim row: the result is a codebook ``(cohort, role, icd_code)``
with one row per rule and code. Diagnosis lines are then labelled by an equi-join on
``icd_code``, a hash lookup per row. Everything is lazy; adaptive execution broadcasts the
codebook if its measured size allows, else the join shuffles and a hot code is split.

Matching is an equi-join too. The patterns form a prefix index, a table of keys: ``=code`` for a whole
code, ``^prefix`` for all codes that begin with it. A code has one key of the first kind and one of
the second for each prefix length in use, so the work for a code does not depend on how many
patterns and rules there are. Only patterns with an inner wildcard are tried one by one.
"""

from __future__ import annotations

import json
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claims_cohorts.columns import COHORT, ICD
from claims_cohorts.functions.codes import icd_match, icd_patterns, pattern_predicate
from claims_cohorts.operators.claims import tag_claims

Rule = tuple[str, str, Sequence[str]]
_INDEX_SCHEMA = f"array<struct<{COHORT}:string,role:string,_key:string>>"


def any_rule(rules: Sequence[Rule]):
    """Predicate of the codes that any of the rules (cohort, role, codes) matches."""
    return icd_match([c for _, _, codes in rules for c in codes])


def prefix_index(rules: Sequence[Rule]) -> tuple[list[dict[str, str]], list[int], list[tuple[str, str, list]]]:
    """(keys with their rule, prefix lengths in use, rules left with patterns that have an inner wildcard)."""
    keys, lengths, others = [], set(), []
    for cohort, role, codes in rules:
        inner = []
        for kind, value in icd_patterns(codes):
            body = value.rstrip("*")
            if kind == "exact" or "*" not in value:
                keys.append({COHORT: cohort, "role": role, "_key": f"={value}"})
            elif "*" not in body:
                lengths.add(len(body))
                keys.append({COHORT: cohort, "role": role, "_key": f"^{body}"})
            else:
                inner.append((kind, value))
        if inner:
            others.append((cohort, role, inner))
    return keys, sorted(lengths), others


def codebook(diagnoses: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(cohort, role, icd_code): each distinct code a rule matches, once per rule however
    many of its patterns match. ``rules`` are (cohort, role, codes)."""
    codes = diagnoses.select(ICD).distinct()
    keys, lengths, others = prefix_index(rules)
    # the whole table is one literal: few calls to build the plan, whatever the number of patterns
    index = F.broadcast(diagnoses.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(keys)), _INDEX_SCHEMA))))  # bounded by the configuration
    own = F.concat(F.lit("="), F.col(ICD))
    begins = F.expr(f"transform(filter(array({', '.join(map(str, lengths))}), n -> n <= length({ICD})), n -> concat('^', substring({ICD}, 1, n)))")
    all_keys = F.concat(F.array(own), begins) if lengths else F.array(own)
    found = codes.select(ICD, F.explode(all_keys).alias("_key")).join(index, "_key").select(COHORT, "role", ICD)
    if others:
        labelled = [({COHORT: cohort, "role": role}, pattern_predicate(F.col(ICD), patterns)) for cohort, role, patterns in others]
        found = found.unionByName(tag_claims(codes, labelled).select(COHORT, "role", ICD))
    # the codes are dealt by code already, so this needs no shuffle of its own
    return found.dropDuplicates([ICD, COHORT, "role"])
