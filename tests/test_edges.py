"""Hand-made edge rows for the cleaning, market, usage and cache operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marktwert.operators import clean, comparables, market, scoring, stats, usage
from marktwert.functions import encode as E

LISTING = ("brand string, model string, vehicleType string, fuelType string, gearbox string, "
           "notRepairedDamage string, powerPS double, kilometer double, yearOfRegistration int, "
           "monthOfRegistration int, price double, name string")


def _row(**kw):
    base = dict(brand="audi", model="a4", vehicleType="limousine", fuelType="benzin", gearbox="manuell",
                notRepairedDamage="nein", powerPS=100.0, kilometer=50000.0, yearOfRegistration=1995,
                monthOfRegistration=3, price=5000.0, name="x")
    base.update(kw)
    return tuple(base[k] for k in ["brand", "model", "vehicleType", "fuelType", "gearbox",
                                    "notRepairedDamage", "powerPS", "kilometer", "yearOfRegistration",
                                    "monthOfRegistration", "price", "name"])


def test_cleaning_bounds_and_null_in_dropped_column(spark):
    rows = [_row(price=200.0), _row(price=199.99), _row(price=20000.0), _row(price=20000.01),
            _row(powerPS=0.0), _row(powerPS=1000.0), _row(powerPS=1001.0),
            _row(name=None),                       # null in a column dropped afterwards
            _row(fuelType="Other"), _row(notRepairedDamage="NaN")]
    df = spark.createDataFrame(rows, LISTING)
    out = clean.clean_listings(df, 2002, drop=["name", "monthOfRegistration"], missing="error")
    got = sorted((r.price, r.powerPS) for r in out.collect())
    assert got == [(200.0, 100.0), (5000.0, 1000.0), (20000.0, 100.0)]
    assert "name" not in out.columns and "age" in out.columns


def test_drop_columns_strict_raises(spark):
    df = spark.createDataFrame([_row()], LISTING)
    with pytest.raises(clean.SchemaError):
        clean.drop_columns(df, ["nope"])
    assert clean.missing_columns(df, ["brand", "nope", "zz"]) == ["nope", "zz"]


def test_strict_encoding_raises_lenient_gives_zero(spark):
    df = spark.createDataFrame([_row(gearbox="halbautomatik")], LISTING)
    with pytest.raises(Exception, match="unmapped value in gearbox"):
        clean.encode_binary(df).collect()
    req = spark.createDataFrame([("Halbautomatik", "maybe")], "gearbox string, notRepairedDamage string")
    r = clean.encode_request(req).first()
    assert (r.gearbox, r.notRepairedDamage) == (0, 0)
    req2 = spark.createDataFrame([("AUTOMATIC", "Yes")], "gearbox string, notRepairedDamage string")
    r2 = clean.encode_request(req2).first()
    assert (r2.gearbox, r2.notRepairedDamage) == (1, 1)


def test_age_groups_right_closed(spark):
    df = spark.createDataFrame([(a,) for a in [0, 3, 4, 100, 101]], "age int")
    got = [r.g for r in df.select(E.age_group("age").alias("g")).collect()]
    assert got == [None, "0-3", "4-5", "20+", None]


def test_year_change_first_year_null_and_single_value_box(spark):
    df = spark.createDataFrame([(1990, 100.0, "a"), (1991, 150.0, "a"), (1991, 250.0, "b")],
                               "yearOfRegistration int, price double, g string")
    rows = {r.yearOfRegistration: r for r in market.year_change(df).collect()}
    assert rows[1990].pct_change is None
    assert rows[1991].pct_change == pytest.approx(100.0)
    box = {r.g: r for r in stats.box_stats(df, "price", "g").collect()}
    assert box["b"].q1 == box["b"].q3 == box["b"].whisker_low == box["b"].whisker_high == 250.0
    assert box["b"].outliers == 0


def test_frequency_ties_break_by_key(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "brand string")
    got = [(r.brand, r["count"]) for r in market.top_keys(df, "brand", 3).collect()]
    assert got == [("c", 2), ("a", 1), ("b", 1)]
    low = [r.brand for r in market.top_keys(df, "brand", 2, ascending=True).collect()]
    assert low == ["a", "b"]


def test_cache_ttl_boundary(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [(1, "k", t0, True), (2, "k", t0 + dt.timedelta(seconds=3599), True),
            (3, "k", t0 + dt.timedelta(seconds=3600), True),
            (4, "k", t0 + dt.timedelta(seconds=7199), True),   # hit: 3599 s after the miss at 3600
            (5, "j", t0, False), (6, "j", t0 + dt.timedelta(seconds=1), True)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp, ok boolean")
    got = {r.id: (r.cache_hit, r.computed) for r in scoring.cache_replay(df, "key", "ts", "id", "ok").collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (False, True), 4: (True, False),
                   5: (False, False), 6: (False, True)}


def test_day_admission_and_microsecond_before_midnight(spark):
    day = dt.datetime(2024, 1, 15)
    rows = [(1, 7, 1, day - dt.timedelta(microseconds=1)),
            (2, 7, 1, day), (3, 7, 1, day + dt.timedelta(hours=1)), (4, 7, 1, day + dt.timedelta(hours=2))]
    log = spark.createDataFrame(
        [(i, u, p, t, "POST /predict", 200, 1.0) for i, u, p, t in rows],
        "id long, user_id long, subscription_plan_id int, request_timestamp timestamp, endpoint string, "
        "status_code int, response_time_ms double")
    plans = usage.plans_frame(spark, [(1, "Free", 1, 2, 0.0)])
    lim = usage.plan_limits(usage.users_from_log(log), plans, plans)
    adm = {r.id: r.admitted for r in usage.quota_admission(log, lim).collect()}
    assert adm == {1: True, 2: True, 3: True, 4: False}
    st = usage.quota_status(log, lim, "2024-01-15 01:00:30").first()
    # the request 1 us before midnight belongs to the previous day
    assert (st.usage_day, st.usage_minute) == (2, 1)
    assert (st.remaining_day, st.limit_per_minute, st.can_predict) == (0, 0, False)


def test_plan_fallback_levels(spark):
    users = spark.createDataFrame([(1, 1), (2, 3), (3, 4)], "user_id long, subscription_plan_id int")
    db = usage.plans_frame(spark, [(1, "Free", 5, 50, 0.0)])
    static = usage.plans_frame(spark)
    got = {r.user_id: (r.limit_per_minute, r.limit_per_day, r.limit_source)
           for r in usage.plan_limits(users, db, static).collect()}
    assert got == {1: (5, 50, "db"), 2: (100, 5000, "static"), 3: (10, 100, "default")}


def test_minute_usage_matches_window_definition(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 30)
    ts = [t0, t0 + dt.timedelta(seconds=20), t0 + dt.timedelta(seconds=60), t0 + dt.timedelta(seconds=61),
          t0 + dt.timedelta(seconds=200)]
    log = spark.createDataFrame([(i, 1, 1, t, "POST /predict", 200, 1.0) for i, t in enumerate(ts)],
                                "id long, user_id long, subscription_plan_id int, request_timestamp timestamp, "
                                "endpoint string, status_code int, response_time_ms double")
    got = {r.id: r.requests_last_minute for r in usage.minute_usage(log).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3, 4: 1}


def test_similar_listings_band_and_self_match(spark):
    rows = [("a", "m", 100.0, 10000.0, 1000.0), ("a", "m", 30.0, 3000.0, 900.0),
            ("a", "m", 131.0, 10000.0, 800.0), ("a", "m", 0.0, 0.0, 700.0), ("b", "m", 100.0, 10000.0, 1.0)]
    df = spark.createDataFrame(rows, "brand string, model string, powerPS double, kilometer double, price double")
    df = df.withColumn("vehicleType", F.lit("x")).withColumn("fuelType", F.lit("y")) \
           .withColumn("yearOfRegistration", F.lit(2000)).withColumn("gearbox", F.lit("g")) \
           .withColumn("notRepairedDamage", F.lit("n"))
    req = comparables.requests_frame(spark, [("a", "m", 100.0, 10000.0), ("a", "m", 0.0, 0.0)])
    got = sorted((r.req_powerPS, r.price) for r in comparables.similar_listings(df, req).collect())
    assert got == [(0.0, 700.0), (100.0, 900.0), (100.0, 1000.0)]
    summ = {r.req_powerPS: (r.n_similar, r.avg_similar_price)
            for r in comparables.similar_summary(df, req).collect()}
    assert summ[100.0] == (2, 950.0)


def test_price_band_text(spark):
    df = spark.createDataFrame([(300.0,), (1234.5,)], "prediction double")
    lo, hi, text = E.price_band("prediction", 500.0)
    got = [(r.lo, r.hi, r.t) for r in df.select(lo.alias("lo"), hi.alias("hi"), text.alias("t")).collect()]
    assert got == [(0.0, 800.0, "0 - 800.0"), (734.5, 1734.5, "734.5 - 1734.5")]


def test_cache_replay_equals_fold(spark):
    """Every key (hot, cold, before 1970) equals a plain fold in time order."""
    import random
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows, i = [], 0
    for key in ["hot", "warm", "cold"]:
        n = {"hot": 400, "warm": 60, "cold": 5}[key]
        for _ in range(n):
            rows.append((i, key, t0 + dt.timedelta(seconds=rnd.randrange(0, 3 * 86400)), rnd.random() > 0.1))
            i += 1
    # exact TTL boundaries and equal timestamps
    edge = i
    rows += [(i, "edge", t0, True), (i + 1, "edge", t0 + dt.timedelta(seconds=3600), True),
             (i + 2, "edge", t0 + dt.timedelta(seconds=3600), True), (i + 3, "edge", t0 + dt.timedelta(seconds=7199), False),
             (i + 4, "edge", t0 + dt.timedelta(seconds=7200), True)]
    old = dt.datetime(1969, 12, 31, 23, 10)
    rows += [(1000 + k, "old", old + dt.timedelta(minutes=20 * k), True) for k in range(12)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "id long, key string, ts timestamp, ok boolean, extra string")
    got = {r.id: (r.cache_hit, r.computed) for r in scoring.cache_replay(df, "key", "ts", "id", "ok").collect()}
    fold, expiry = {}, {}
    for k, key, ts, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = key in expiry and ts < expiry[key]
        fold[k] = (hit, ok and not hit)
        if ok and not hit:
            expiry[key] = ts + dt.timedelta(seconds=3600)
    assert got == fold
    assert got[edge + 1] == (False, True) and got[edge + 2] == (True, False) and got[edge + 4] == (False, True)
    assert [k - 1000 for k in range(1000, 1012) if got[k][1]] == [0, 3, 6, 9]


def test_admission_with_the_real_limits(spark):
    """Premium allows 5,000 a day; the next request of that day is rejected."""
    day = dt.datetime(2024, 1, 1)
    log = spark.range(5_200).selectExpr("id", "1L as user_id", "3 as subscription_plan_id",
                                        f"timestamp '{day}' + make_dt_interval(0, 0, 0, id * 7) as request_timestamp",
                                        "'POST /predict' as endpoint", "200 as status_code", "1.0D as response_time_ms")
    limits = usage.plan_limits(usage.users_from_log(log), usage.plans_frame(spark), usage.plans_frame(spark))
    got = usage.quota_admission(log, limits)
    assert got.where("admitted").count() == 5000
    assert got.where("not admitted").agg(F.min("id"), F.max("status_code")).first()[:] == (5000, 429)


def test_request_hash_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("a", None)], "x string, y string")
    got = [r[0] for r in df.select(scoring.request_hash(["x", "y"])).collect()]
    assert len(set(got)) == 3 and got[0] == got[3]


def test_split_separates_rows_of_equal_power_and_age(spark):
    """Whole-euro prices and 5,000-km steps: (power, age) does not decide the
    side, shares agree, and salts are independent."""
    from marktwert.operators import evaluation as EV
    df = spark.range(40_000).selectExpr(
        "concat('b', id % 7) as brand", "concat('m', id % 41) as model", "'x' as vehicleType", "'y' as fuelType",
        "cast(id % 2 as int) as gearbox", "cast(null as int) as notRepairedDamage",
        "cast(60 + 15 * (id % 20) as double) as powerPS", "cast(5000 * (id % 31) as double) as kilometer",
        "cast(id % 19 as int) as age", "cast(500 + id % 9973 as double) as price")
    train, test = EV.train_test_split(df)
    assert train.count() + test.count() == 40_000
    assert abs(test.count() / 40_000 - 0.2) < 0.01
    both = test.select("powerPS", "age").distinct().join(train.select("powerPS", "age").distinct(), ["powerPS", "age"])
    assert both.count() > 0.95 * df.select("powerPS", "age").distinct().count()
    by_brand = [r[0] for r in df.withColumn("t", EV.split_key(df) < EV.share_text(0.2)).groupBy("brand").agg(
        F.avg(F.col("t").cast("double"))).select("avg(CAST(t AS DOUBLE))").collect()]
    assert max(abs(x - 0.2) for x in by_brand) < 0.03
    flagged = EV.with_validation_flag(train)
    assert abs(flagged.where("is_validation").count() / train.count() - 0.2) < 0.01
    folds = [r["count"] for r in EV.with_folds(train, 5).groupBy("fold").count().collect()]
    assert len(folds) == 5 and max(folds) < 1.1 * min(folds)


def test_mean_keeps_fractions(spark):
    from marktwert.operators import market
    df = spark.createDataFrame([(1.9,), (2.9,), (None,)], "powerPS double")
    assert df.agg(market.mean_exact("powerPS")).first()[0] == 2.4


def test_similar_listings_equal_a_plain_loop_with_few_cells_met(spark, monkeypatch):
    """Ties, null prices and more cells than are kept: the ranked rows are those of
    a plain loop, and each power of a request's band brings its first cells only."""
    import random
    from marktwert.operators import comparables
    rng, rows = random.Random(4), []
    for i in range(700):
        rows.append(("b", "m" if i % 9 else "n", rng.choice([0.0, 40.0, 50.0, 60.0, 100.0]), float(rng.randrange(0, 60)) * 1000,
                     rng.choice([None, 100.0, 200.0, 300.0 + i % 7]), "v", "f", 2000 + rng.randrange(3), "g", None))
    names = ["brand", "model", "powerPS", "kilometer", "price", "vehicleType", "fuelType", "yearOfRegistration",
             "gearbox", "notRepairedDamage"]
    cars = spark.createDataFrame(rows, "brand string, model string, powerPS double, kilometer double, price double, "
                                 "vehicleType string, fuelType string, yearOfRegistration int, gearbox string, notRepairedDamage string")
    met, real = [], comparables._in_band
    monkeypatch.setattr(comparables, "_in_band", lambda *a: met.append(real(*a)) or met[-1])
    requests = comparables.distinct_requests(cars)
    got: dict = {}
    for r in comparables.similar_listings(cars, requests).collect():
        got.setdefault((r.brand, r.model, r.req_powerPS, r.req_kilometer), []).append(
            (r["rank"], r.price, r.powerPS, r.kilometer, r.yearOfRegistration))
    at = {n: i for i, n in enumerate(names)}
    want = {}
    for b, m, p, k in {x[:4] for x in rows}:
        like = [x for x in rows if x[:2] == (b, m) and p * 0.3 <= x[2] <= p * 1.3 and k * 0.3 <= x[3] <= k * 1.3]
        like.sort(key=lambda x: [(x[at[c]] is not None, x[at[c]] or 0) for c in ("price", "powerPS", "kilometer", "yearOfRegistration")])
        want[b, m, p, k] = [(i + 1, x[4], x[2], x[3], x[7]) for i, x in enumerate(like[:10])]
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    strips, pairs = met
    direct = comparables.matched_cells(requests, comparables.listing_cells(cars)[0]).count()
    assert strips.count() < direct and pairs.selectExpr("sum(size(_cells))").first()[0] < direct
