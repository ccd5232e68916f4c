import pytest
from pyspark.sql import types as T
from pyspark.sql import functions as F

from recordrisk.functions import tables as R
from recordrisk.operators import clean as B, encode as E, profile as P
from recordrisk.sources import io
from recordrisk.schemas import RAW_RECORD
from recordrisk.workspace import shared_folder
from tests.conftest import by_id, column


def test_map_and_replace_differ(spark):
    df = by_id(spark, ["Bengaluru", "Pune", None])
    assert column(B.map_values(df, "v", R.CITY_FIXES), "v") == ["Bangalore", None, None]
    assert column(B.replace_values(df, "v", R.CITY_FIXES), "v") == ["Bangalore", "Pune", None]


def test_select_rename_fill(spark):
    df = by_id(spark, ["a", None])
    assert B.select_columns(df, ["v", "absent"], existing_only=True).columns == ["v"]
    assert B.rename_columns(df, ["x", "y"]).columns == ["x", "y"]
    assert B.rename_columns(df, {"v": "w"}).columns == ["id", "w"]
    assert column(B.fill_missing(df, {"v": "Unknown"}), "v") == ["a", "Unknown"]
    nan = by_id(spark, [float("nan"), None, 2.0], "double")
    assert column(B.fill_missing(nan, {"v": 0.0}), "v") == [0.0, 0.0, 2.0]
    assert column(B.stringify_category(df, "v"), "v") == ["a", "nan"]


def test_null_audit(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert {(r[0], r[1]) for r in B.null_audit(df).collect()} == {("a", 1), ("b", 2)}
    assert B.null_audit(df.where("a = 3")).count() == 0
    assert B.null_audit(df.where("a = 9"), only_missing=False).count() == 2


def test_fold_rare(spark):
    df = by_id(spark, ["a"] * 3 + ["b"] * 2 + ["c", "d", None])
    assert column(E.fold_rare(df, "v", 2), "v") == ["a"] * 3 + ["b"] * 2 + ["Other"] * 3
    assert column(E.fold_rare(df, "v", 3), "v")[5:] == ["c", "Other", "Other"]


@pytest.mark.parametrize("limit", [2, 20_000])
def test_ordinal_is_bijective_and_sorted(spark, monkeypatch, limit):
    """Small and large numbers of values (the latter by range sort) give the same codes."""
    small = E.small_or_none
    monkeypatch.setattr(E, "small_or_none", lambda df, n=limit: small(df, n))
    values = ["pear", "apple", None, "fig", "apple", "Zebra", "kiwi"]
    df = by_id(spark, values)
    table = E.fit_ordinal(df, "v")
    assert {r["value"]: r["code"] for r in table.collect()} == {
        v: i for i, v in enumerate(sorted({v for v in values if v}))}
    coded = column(E.apply_ordinal(df, "v", table), "vEncoded")
    assert coded == [4, 1, None, 2, 1, 0, 3]
    named = E.fit_ordinal(df, "v", null_label="nan")
    assert column(E.apply_ordinal(df, "v", named, null_label="nan"), "vEncoded")[2] == 4


def test_apply_encoding_default_and_wide_table(spark, monkeypatch):
    df = by_id(spark, ["Pune", "Delhi", None, "Atlantis"])
    codes = io.encoding_table(spark, {"v": {"Pune": 7, "Delhi": 3}, "w": {"Pune": 1}})
    for small, case in ((1, 1), (100, 1), (100, 64)):  # joined, broadcast, one expression
        monkeypatch.setattr(E, "SMALL_ROWS", small)
        monkeypatch.setattr(E, "CASE_VALUES", case)
        assert column(E.apply_encoding(df, "v", codes, 0), "vEncoded") == [7, 3, 0, 0]
        assert column(E.apply_encoding(df, "v", codes), "vEncoded") == [7, 3, None, None]


def test_profile_of_empty_and_missing(spark):
    df = by_id(spark, ["a", "a", None, "b"])
    assert [tuple(r) for r in P.value_counts(df, "v").collect()] == [("a", 2), ("b", 1)]
    empty = df.where("id > 99")
    assert P.value_counts(empty, "v").count() == 0
    assert P.class_balance(empty, "v").count() == 0
    row = P.crosstab(df.withColumn("p", F.lit("Safe")), "v", "p", ["Failed", "Safe"]).where("v = 'a'").first()
    assert (row["Failed"], row["Safe"]) == (0, 2)


def test_kpis(spark):
    schema = "Prediction string, Confidence double"
    empty = spark.createDataFrame([], schema)
    row = P.log_kpis(empty).first()
    assert (row["total"], row["survival_rate"], row["avg_confidence_text"], row["avg_confidence"]) == (0, "_", "_", None)
    # 1 of 8 is 12.5 percent: half to even
    log = spark.createDataFrame([("Safe", 0.5)] + [("Failed", 0.25)] * 7, schema)
    row = P.log_kpis(log).first()
    assert (row["safe"], row["failed"], row["survival_rate"]) == (1, 7, "12%")


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2), (2.0, 5.0, 1), (3.0, 5.0, 0), (None, 5.0, 4)], "a double, k double, t int")
    rows = [tuple(r) for r in P.correlation_with_target(df, ["k", "a"], "t").collect()]
    assert rows[0][0] == "a" and abs(rows[0][1] + 1) < 1e-12
    assert rows[1] == ("k", None)


def test_latest_prediction(spark):
    log = spark.createDataFrame([(1, "x", "Safe"), (3, "x", "Failed"), (2, "y", "Safe")], "pred_id int, k string, p string")
    rows = P.latest_prediction(log, "pred_id", "k").orderBy("k").collect()
    assert [(r["k"], r["pred_id"], r["p"]) for r in rows] == [("x", 3, "Failed"), ("y", 2, "Safe")]
    assert P.latest_prediction(log.where("pred_id > 9"), "pred_id").count() == 0


def test_csv_round_trip_keeps_every_text(spark):
    rows = [(1, ' a "quoted", text ', "IN", None, "x", " seed ", "1,200.50", None, "d", "d", "d", "s")]
    df = spark.createDataFrame(rows, RAW_RECORD)
    path = shared_folder(spark, "csv")
    io.write_records(df, path, "csv")
    assert io.read_records(spark, path, RAW_RECORD).collect() == df.collect()


def test_log_upgrade(spark):
    old = spark.createDataFrame([(1, 10, 2, 6, 3, "Safe")], "pred_id long, Funding long, Rounds long, City long, Industry long, Prediction string")
    row = io.upgrade_log_v1(old).first()
    assert (row["City"], row["Industry"], row["Stage"], row["Confidence"]) == ("6", "3", None, None)
    row = io.upgrade_log_v1(old, io.encoding_table(spark, io.DASHBOARD_CODES)).first()
    assert (row["City"], row["Industry"]) == ("Bangalore", "E-Commerce")


def test_codes_listed_twice_are_the_same_by_every_path(spark):
    values = [f"v{i}" for i in range(30)] + [None, "new"]
    df = by_id(spark, values)
    table = io.encoding_table(spark, {"v": {f"v{i}": i for i in range(30)}})
    table = table.unionByName(spark.createDataFrame([("v", "v3", 99), ("v", "v4", -1), ("w", "v5", -7)], table.schema))
    got = [column(E.apply_encoding(df, "v", table, 50, case_values=c, small_rows=s), "vEncoded") for c, s in ((64, 100), (10, 100), (10, 5))]
    want = list(range(30)) + [50, 50]
    want[4] = -1
    assert got == [want] * 3


def test_long_texts_are_no_small_lookup(spark):
    from recordrisk.workspace import small_or_none

    df = by_id(spark, ["x" * 1000] * 20)
    assert small_or_none(df, 20, 30_000) is not None
    assert small_or_none(df, 20, 10_000) is None and small_or_none(df, 19, 30_000) is None
    long = by_id(spark, [f"{i} " + "x" * 1000 for i in range(20)])
    assert len(E.fold_rare(long, "v", 20).where("v <> 'Other'").collect()) == 20
    assert sorted(column(E.apply_ordinal(long, "v", E.fit_ordinal(long, "v")), "vEncoded")) == list(range(20))


def test_bad_lines_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,name,amount\n1,a,2.5\nx,b,3\n3,c,4,extra\n4\n5,e,NaN\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("amount", T.DoubleType())])
    rows = io.read_records(spark, str(tmp_path), schema, corrupt="bad").orderBy("name").collect()
    assert {r["bad"] for r in rows} == {None, "x,b,3", "3,c,4,extra", "4"}
    assert io.corrupt_rows(spark, str(tmp_path), schema) == 3
    assert io.read_records(spark, str(tmp_path), schema).columns == ["id", "name", "amount"]
    assert [r["amount"] for r in rows if r["id"] == 5] == [None]
    with pytest.raises(Exception):
        io.read_records(spark, str(tmp_path), schema, mode="FAILFAST").collect()


def test_line_breaks_survive(spark):
    df = spark.createDataFrame([(1, 'two\nlines, "quoted"'), (2, "one")], "id long, t string")
    path = shared_folder(spark, "csv")
    io.export_log(df, path)
    assert io.read_records(spark, path, df.schema, multiline=True).orderBy("id").collect() == df.collect()
