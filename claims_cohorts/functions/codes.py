"""Code-pattern predicates (ICD, procedure, drug, claim type) as Spark Columns.

Patterns are rewritten on the driver only; the data path sees ``isin`` (pushed to
Parquet as ``In``), ``startswith`` (pushed as ``StringStartsWith``) and, for any
pattern with an inner wildcard, ``like``. Long lists of prefixes become one set look-up
per prefix length: a test per prefix would cost each row in proportion to the list, and the
generated code of a long chain is too large for the JVM to compile.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: More prefixes than these are looked up by length.
MANY_PREFIXES = 16


def any_of(columns: Iterable[Column]) -> Column:
    cols = list(columns)
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def all_of(columns: Iterable[Column]) -> Column:
    cols = list(columns)
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


def icd_patterns(codes: Sequence[str]) -> list[tuple[str, str]]:
    """(kind, value) of ICD codes: ``exact``, or ``glob`` with ``*`` as its only wildcard.

    A code containing ``*`` or ``.`` is a glob; if it contains a dot, its dot-free
    spelling is matched too. Any other code is matched exactly, whatever its characters.
    """
    out: list[tuple[str, str]] = []
    for code in codes:
        kind = "glob" if "*" in code or "." in code else "exact"
        out.append((kind, code))
        if kind == "glob" and "." in code:
            out.append((kind, code.replace(".", "")))
    return list(dict.fromkeys(out))


def procedure_patterns(codes: Sequence[str]) -> list[tuple[str, str]]:
    """Procedure codes: globs like ICD codes, without the dot-free spelling."""
    return list(dict.fromkeys(("glob" if "*" in c or "." in c else "exact", c) for c in codes))


def pattern_predicate(col: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """OR of all patterns, using the cheapest exact form of each.

    No wildcard → one ``isin`` for all of them; only trailing ``*`` → ``startswith``, or one
    ``isin`` of the column's first characters per prefix length where there are many;
    anything else → ``like`` with the SQL wildcards escaped.
    """
    exact = [v for kind, v in patterns if kind == "exact" or "*" not in v]
    globs = [v for kind, v in patterns if kind == "glob" and "*" in v]
    preds: list[Column] = []
    if exact:
        preds.append(col.isin(list(dict.fromkeys(exact))))
    prefixes = list(dict.fromkeys(v.rstrip("*") for v in globs if "*" not in v.rstrip("*")))
    if len(prefixes) > MANY_PREFIXES:
        by_length: dict[int, list[str]] = {}
        for body in prefixes:
            by_length.setdefault(len(body), []).append(body)
        preds.extend(F.substring(col, 1, n).isin(some) for n, some in sorted(by_length.items()))
    else:
        preds.extend(col.startswith(body) for body in prefixes)
    for v in globs:
        if "*" in v.rstrip("*"):
            escaped = "".join("\\" + ch if ch in "\\%_" else ch for ch in v)
            preds.append(col.like(escaped.replace("*", "%")))
    return any_of(preds)


def icd_match(codes: Sequence[str], col: Column | str = "icd_code") -> Column:
    """ICD pattern match (case-sensitive; null never matches)."""
    c = F.col(col) if isinstance(col, str) else col
    return pattern_predicate(c, icd_patterns(codes))


def procedure_match(codes: Sequence[str], col: Column | str = "proc_code") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return pattern_predicate(c, procedure_patterns(codes))


def drug_match(names: Sequence[str], col: Column | str = "product_service_name") -> Column:
    """Drug names: LIKE when the name holds ``*`` or ``%``, else equality.

    ``*`` is not translated, so inside a LIKE pattern it is a literal character.
    """
    c = F.col(col) if isinstance(col, str) else col
    exact = [n for n in names if "*" not in n and "%" not in n]
    likes = [n for n in names if "*" in n or "%" in n]
    preds: list[Column] = []
    if exact:
        preds.append(c.isin(list(dict.fromkeys(exact))))
    preds.extend(c.like(n) for n in dict.fromkeys(likes))
    return any_of(preds)


def claim_type_match(types: Sequence[str], col: Column | str = "claim_type") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isin(list(types)) if types else F.lit(False)


def date_range_filter(years: int, as_of=None, col: Column | str = "date_of_service") -> Column:
    """``date >= as_of - years`` (calendar years, end-of-month clamped).

    ``as_of`` defaults to ``current_date()``; pass a date (or 'YYYY-MM-DD') to pin it.
    """
    c = F.col(col) if isinstance(col, str) else col
    if as_of is None:
        anchor = F.current_date()
    elif isinstance(as_of, Column):
        anchor = as_of
    else:
        anchor = F.lit(str(as_of)).cast("date")
    return c >= F.add_months(anchor, -12 * int(years))
