import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recordrisk.functions import columns as C, tables as R
from recordrisk.functions.narrative import advice_text, reason_text, with_amounts
from tests.conftest import by_id, column


def run(spark, values, fn, kind="string"):
    return column(by_id(spark, values, kind).withColumn("out", fn("v")), "out")


STAGES = {
    "Pre-Seed": 1, "pre seed fund": 1, "ANGEL round": 1, "Friends & family": 1, "Seed Round": 2, "  seed\t": 2,
    "Pre-Series A": 3, "pre series a": 3, "Bridge": 3, "Series A": 4, "SERIES B": 5, "series c-1": 6, "Series D": 7,
    "Series E": 7, "Series F": 7, "Private Equity": 8, "Unspecified": 8, "open": 8, "Post-IPO": 9, "public": 9,
    "Debt": 2, "term loan": 2, "Registered": 2, "": 2, "whatever": 2, None: 2,
}


def test_stage_train(spark):
    assert run(spark, list(STAGES), C.stage_code) == list(STAGES.values())


def test_stage_serve(spark):
    cases = {"Pre-seed / Angel": 1, "pre seed": 2, "Pre-Series B": 3, "Series F": 2, "Unspecified": 2, "IPO": 9,
             "Private Equity": 8, "public": 2, None: 2}
    assert run(spark, list(cases), lambda c: C.stage_code(c, "serve")) == list(cases.values())


def test_every_stage_keyword_reaches_its_rule(spark):
    for rules, name in ((R.STAGE_RULES_TRAIN, "train"), (R.STAGE_RULES_SERVE, "serve")):
        words = [(w, code) for code, ws in rules for w in ws]
        got = run(spark, [w.upper() for w, _ in words], lambda c: C.stage_code(c, name))
        expected = []
        for word, _ in words:
            expected.append(next(code for code, ws in rules if any(w in word for w in ws)))
        assert got == expected


INDUSTRIES = {
    "Online Education": "EdTech", "agritech": "Tech/SaaS", "FoodTech": "Tech/SaaS", "proptech": "Tech/SaaS",
    "Food": "FoodTech", "Lending": "FinTech", "Pharma": "HealthTech", "Retail": "E-Commerce", "Supply chain": "Logistics",
    "Renting": "RealEstate", "Agriculture": "AgriTech", "News": "Media", "Metals": "Manufacturing",
    "Social": "Services", "Tourism": "Travel", "Space": "Other", "": "Other", None: "Other", " HEALTH ": "HealthTech",
}


def test_industry_train(spark):
    assert run(spark, list(INDUSTRIES), C.industry_class) == list(INDUSTRIES.values())


def test_industry_serve(spark):
    cases = {"Training": "Services", "Lending": "Services", "Travel": "Services", "Supply": "Logistics",
             "Space": "Services", "edtech": "EdTech", None: "Services"}
    assert run(spark, list(cases), lambda c: C.industry_class(c, "serve")) == list(cases.values())


def test_band_edges(spark):
    values = [0.0, 99_999.99, 1e5, 499_999.0, 5e5, 2e6, 9_999_999.0, 1e7, None, -1.0]
    assert run(spark, values, C.band, "double") == [0, 1, 2, 2, 3, 4, 4, 5, 5, 1]


def test_number_and_money(spark):
    texts = ["12", " 1.5 ", "1,200", "-", "12d", "1e3", "abc", "", None, "-3", "inf"]
    assert run(spark, texts, C.number) == [12.0, 1.5, None, None, None, 1000.0, None, None, None, -3.0, math.inf]
    assert run(spark, texts[:4], lambda c: C.number_or(c, 0)) == [12.0, 1.5, 0.0, 0.0]
    assert run(spark, ["-", "1,234,567.50", "7", None], C.money) == [0.0, 1234567.5, 7.0, None]
    assert run(spark, ["-", "x"], lambda c: C.money(c, "null")) == [0.0, None]
    with pytest.raises(Exception):
        run(spark, ["x"], C.money)


def test_small_expressions(spark):
    assert run(spark, [None, 0, 5], C.floor_fill, "int") == [1, 1, 5]
    assert run(spark, [None, 1, 5], lambda c: C.cap_at(c, F.lit(3)), "int") == [None, 1, 3]
    assert run(spark, [None, -1.0, -4.0, 0.0], C.log1p, "double") == [None, None, None, 0.0]
    assert run(spark, [None, "a", "b"], lambda c: C.membership_flag(c, ["a"])) == [0, 1, 0]
    assert run(spark, [None, "operating", "x"], lambda c: C.map_literal(c, R.STATUS_CODES)) == [None, 0, None]
    assert run(spark, [None, 1, 77], lambda c: C.decode_label(c, R.STAGE_LABELS), "int") == [None, "Pre-seed/Angel", "77"]
    assert run(spark, [None, 1, 0], C.binary_target, "int") == [0, 1, 0]
    assert run(spark, [None, 1, 0], C.outcome_label, "int") == ["Failed", "Safe", "Failed"]
    assert run(spark, [0.71, 0.7, 0.5], lambda c: C.rate_tier(c, 0.7, 0.5), "double") == ["high", "middle", "low"]
    assert run(spark, [4.0, None], lambda c: C.safe_ratio(c, F.lit(0)), "double") == [None, None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(min_value=0.0625, max_value=1e6), min_size=200, max_size=400))
def test_fixed_text_is_the_exact_rounding(spark, values):
    values += [0.125, 0.25, 0.375, 1.15, 1.05, 2.5, 0.285, 99.95, 12.345]
    for digits in (1, 2):
        got = run(spark, values, lambda c: C.fixed_text(c, digits), "double")
        assert got == [f"{v:.{digits}f}" for v in values]


def _texts(spark, rows, style="service"):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "id long, p string, f double, r int, city string, ind string, stage string")
    df = with_amounts(df, "f").select("id", reason_text("p", "f", "r", "city", "ind", "stage", style).alias("reason"),
                   advice_text("p", "f", "r", "city", style).alias("advice"))
    return column(df, "reason"), column(df, "advice")


def test_safe_reasons(spark):
    reasons, advice = _texts(spark, [
        ("Safe", 12_340_000.0, 4, "Pune", "EdTech", "Series B"),
        ("Safe", 1_150_000.0, 2, "Goa", "Media", "Private Equity"),
        ("Safe", 600_000.0, 1, "Goa", "Media", "Seed"),
        ("Safe", 6_000_000.0, 2, "Mumbai", "Other", "IPO"),
    ])
    assert reasons == [
        "This startup shows strong funding of $12.3M, and 4 funding rounds showing investor confidence, and strong startup ecosystem in Pune.",
        "This startup shows solid funding of $1.1M, and 2 funding rounds indicating traction, and late-stage funding indicating maturity.",
        "This startup shows early-stage funding in place.",
        "This startup shows solid funding of $6.0M, and 2 funding rounds indicating traction, and strong startup ecosystem in Mumbai.",
    ]
    assert [a.split()[0] for a in advice] == ["Excellent", "Good", "Consider", "Strong"]


def test_failed_reasons(spark):
    rows = [
        ("Failed", 50_000.0, 1, "Goa", "Media", "Bridge"),
        ("Failed", 250_000.0, 2, "Pune", "EdTech", "Unknown"),
        ("Failed", 900_000.0, 2, "Pune", "EdTech", "Seed"),
        ("Failed", 900_000.0, 2, "Goa", "Media", "Debt"),
    ]
    reasons, advice = _texts(spark, rows)
    assert reasons == [
        "Warning signals detected: very limited funding runway, limited investor backing, limited startup ecosystem support in Goa.",
        "Warning signals detected: insufficient capital ($0.25M), debt/bridge financing signals financial stress.",
        "Warning signals detected: combination of market and operational risk factors.",
        "Warning signals detected: limited startup ecosystem support in Goa, challenging market conditions for Media, debt/bridge financing signals financial stress.",
    ]
    assert [a.split()[0] for a in advice] == ["Urgently", "Urgently", "Re-evaluate", "Consider"]
    reasons, _ = _texts(spark, rows, "dashboard")
    assert reasons[1] == "Warning signals detected: insufficient capital ($0.25M)."
    assert reasons[3] == ("Warning signals detected: limited startup ecosystem in Goa, challenging market for Media sector, "
                          "debt/bridge financing signals financial stress.")


def test_unfloored_rounds_and_missing_city(spark):
    reasons, _ = _texts(spark, [("Failed", 900_000.0, 0, None, "EdTech", "Seed")])
    assert reasons == ["Warning signals detected: limited investor backing."]
