"""Replayed appends, observed clip counts, body names, splittable CSV."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktwert import config as C
from marktwert.operators import clean, usage
from marktwert.operators.features import OutlierClipper
from marktwert.sources import files


def test_replayed_batch_adds_no_row(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "user_id long, endpoint string")
    usage.append_log(rows, path, 0)
    for _ in range(2):
        usage.append_log(rows.where("user_id = 2"), path, 1)
    assert sorted(tuple(r) for r in usage.read_log(spark, path).collect()) == [(1, "a")] + [(2, "b")] * 4


def test_counts_come_with_the_clipping_pass(spark):
    df = spark.createDataFrame([(float(v), float(-v)) for v in [1, 2, 3, 4, 5, 100]] + [(None, 3.0)], "a double, b double")
    model = OutlierClipper(inputCols=["a", "b"]).fit(df)
    out, seen = model.transform_counted(df)
    rows = out.collect()
    want = model.outlier_counts(df).first().asDict()
    assert seen.get == want and want["a"] == 1
    assert max(r["a"] for r in rows if r["a"] is not None) == model.bounds["a"][1]


def test_all_body_and_fuel_names(spark):
    names = [(b, f) for b, f in zip([*C.BODY_TRANSLATION, "kutsche"], [*C.FUEL_TRANSLATION, "dampf", None])]
    df = spark.createDataFrame(names, "vehicleType string, fuelType string")
    got = {(r["vehicleType"], r["fuelType"]) for r in clean.translate_values(df).collect()}
    assert got == {(C.BODY_TRANSLATION.get(b), C.FUEL_TRANSLATION.get(f)) for b, f in names}
    assert {b for b, _ in got} >= {"sedan", "small car", "station wagon", "bus", "convertible", "coupe", "suv", "other"}


def test_csv_without_quoted_breaks_is_split(spark, tmp_path):
    path = str(tmp_path / "csv")
    files.write_csv(spark.range(20_000).select(F.col("id"), F.concat(F.lit('say "x", '), "id").alias("t")).coalesce(1), path)
    schema = spark.createDataFrame([], "id long, t string").schema
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        whole, split = (files.scan_listings_csv(spark, path, schema, quoted_breaks=q) for q in (True, False))
        assert split.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
        assert split.exceptAll(whole).isEmpty() and split.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
