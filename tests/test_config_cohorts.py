import pytest

from claims_cohorts.plans.cohorts import build_cohort, build_cohorts, cohort_logic, COHORT_LOGIC_REGISTRY
from claims_cohorts.plans.spec import config_from_text, load_config
from tests.helpers import D, as_set, claims_tables


def test_shipped_config_yaml_oddities():
    cfg = load_config()
    assert len(cfg.names()) == 18
    assert cfg.exclusion("GDM")["pre_existing_diabetes"] == ["O24.0*", "O24.1*"]  # last duplicate key wins
    exc = cfg.exclusion("Metabolic_Syndrome")
    assert exc["pregnancy"] == ["O00.*", "O9A.*", "O24.4*"] and exc["cancer"] == ["C*", "D*", "Z85.*"]
    assert cfg.inclusion("IBS_D")["symptom_codes"] == ["R19.7", "R14.", "R10."]  # explicit key beats merge


def test_missing_inclusion_is_value_error():
    with pytest.raises(ValueError):
        config_from_text("cohorts:\n  X:\n    exclusion: {}\n")


TEXT = """
cohorts:
  A:
    inclusion:
      icd_codes: ["I10"]
      min_claims: 2
      min_days_between_claims: 30
      claim_types: ["medical"]
    exclusion:
      subtypes: ["K58.1"]
      subtype_window_days: 10
  NoMin:
    inclusion:
      icd_codes: ["I10"]
"""

ENTRIES = [
    (1, "p", "2023-01-01", "medical"), (2, "p", "2023-03-01", "medical"),
    (3, "q", "2023-01-01", "medical"), (4, "q", "2023-03-01", "medical"), (5, "q", "2023-01-05", "pharma"),
    (6, "r", "2023-01-01", "pharma"), (7, "r", "2023-03-01", "pharma"),
]
DX = [(1, "I10"), (2, "I10"), (3, "I10"), (4, "I10"), (5, "K58.1"), (6, "I10"), (7, "I10")]


def test_default_path_small(spark):
    cfg = config_from_text(TEXT)
    t = claims_tables(spark, ENTRIES, DX, members=[("p", "Pat")])
    out = build_cohort(t, cfg, "A", as_of="2024-01-01", registry={})
    assert out.columns == ["member_id_hash", "index_date", "member_name", "cohort"]
    assert as_set(out) == {("p", D("2023-01-01"), "Pat", "A")}


def test_unknown_cohort_and_missing_key(spark):
    cfg = config_from_text(TEXT)
    t = claims_tables(spark, ENTRIES, DX)
    with pytest.raises(KeyError):
        build_cohort(t, cfg, "Nope", registry={})
    with pytest.raises(KeyError):
        build_cohort(t, cfg, "NoMin", registry={})


def test_registry_overrides_and_need_not_be_in_yaml(spark):
    cfg = config_from_text(TEXT)
    t = claims_tables(spark, ENTRIES, DX)
    reg = {}

    def custom(ctx, name):
        return ctx.tables.entries.selectExpr("member_id_hash", "date_of_service AS index_date", f"'{name}' AS cohort")

    reg["Custom"] = custom
    out = build_cohort(t, cfg, "Custom", registry=reg)
    assert out.count() == len(ENTRIES)
    both = build_cohorts(t, cfg, ["A", "Custom"], as_of="2024-01-01", registry=reg)
    assert both.count() == len(ENTRIES) + 1


def test_decorator_registers_globally():
    @cohort_logic("Decorated_Test")
    def fn(ctx, name):
        return None

    try:
        assert COHORT_LOGIC_REGISTRY["Decorated_Test"] is fn
    finally:
        COHORT_LOGIC_REGISTRY.pop("Decorated_Test", None)


def test_cohort_with_no_qualifying_member(spark):
    cfg = config_from_text(TEXT.replace('["I10"]', '["Z99"]', 1))
    t = claims_tables(spark, ENTRIES, DX, members=[("p", "Pat")])
    out = build_cohort(t, cfg, "A", registry={})
    assert out.count() == 0 and out.columns == ["member_id_hash", "index_date", "member_name", "cohort"]


def test_cohort_builder(spark):
    from claims_cohorts import CohortBuilder
    from claims_cohorts.sources.testdata import AS_OF, testdata_tables

    b = CohortBuilder(testdata_tables(spark, "/root/testdata/sf0.001"), as_of=AS_OF)
    assert b.build_cohort("HTN_Conservative").count() == 52
    assert "has_symptom_code" in b.inclusion_claims("IBS_D").columns
    assert any("utilization" in w for w in b.warnings)


def test_builtin_strategies_by_name(spark):
    from claims_cohorts.plans.strategies import strategy_registry, use_strategy
    from claims_cohorts.sources.testdata import AS_OF, testdata_tables

    t = testdata_tables(spark, "/root/testdata/sf0.001")
    cfg = load_config()
    reg = strategy_registry({"PreDiabetes": "diabetes", "CAD_Sensitive": "cardiometabolic"})
    assert build_cohort(t, cfg, "PreDiabetes", AS_OF, registry=reg).count() == 2
    assert build_cohort(t, cfg, "CAD_Sensitive", AS_OF, registry=reg).count() == 47
    private = {}
    use_strategy("GDM", "diabetes", registry=private)
    assert build_cohort(t, cfg, "GDM", AS_OF, registry=private).count() == 4


def test_many_cohorts_in_one_plan_equal_single_builds(spark):
    """40 variants of the shipped cohorts (different gaps / windows) in one plan: each
    equals its own single-cohort build."""
    import copy

    from claims_cohorts.plans.spec import parse_config
    from claims_cohorts.sources.testdata import AS_OF, testdata_tables

    base = load_config()
    cohorts = {}
    for i in range(40):
        src = base.names()[i % len(base.names())]
        c = copy.deepcopy(base.cohort(src))
        c["inclusion"]["min_days_between_claims"] = 15 + (i * 7) % 60
        if "subtype_window_days" in (c.get("exclusion") or {}):
            c["exclusion"]["subtype_window_days"] = 30 + i
        cohorts[f"{src}_v{i}"] = c
    cfg = parse_config({"cohorts": cohorts})
    t = testdata_tables(spark, "/root/testdata/sf0.1")
    together = build_cohorts(t, cfg, as_of=AS_OF, registry={})
    for name in ["IBS_D_v1", "CAD_Sensitive_v17", "HTN_Conservative_v12", "IBS_U_v21"]:
        alone = build_cohort(t, cfg, name, as_of=AS_OF, registry={})
        mine = together.where(f"cohort = '{name}'")
        assert mine.count() == alone.count() > 0
        assert mine.exceptAll(alone).count() == 0
