"""Prices, labels, report texts and the schedule."""

from pyspark.sql import functions as F

from pricelens.functions import labels as L
from pricelens.functions import prices as P
from pricelens.functions import report as R
from pricelens.functions.schedule import class_of_local, run_class


def test_coercions(apply):
    assert apply(P.num_or_null, ["12", " 1.5 ", "0", "", "x", "12x", "1e3", None]) == [
        12.0, 1.5, None, None, None, None, 1000.0, None,
    ]
    assert apply(P.float_prefix, ["12.5x", "0", "x", "-3"]) == [12.5, None, None, -3.0]
    assert apply(P.int_prefix, ["12.9", " 7a", "a7", "0"]) == [12.0, 7.0, None, None]
    assert apply(P.parse_price_text, ["359,000 դր.", "0 դր", "5 AMD", "1 2,0 դր"]) == [
        359000.0, None, None, 120.0,
    ]
    assert apply(P.digits_price, ["12 000 ֏", "-", "0"]) == [12000.0, None, None]
    assert apply(P.round_price, [1.5, 2.49, 2.5], "double") == [2.0, 2.0, 3.0]


def _flag(spark, rows):
    df = spark.createDataFrame(rows, "i int, a double, c double")
    out = df.select("i", P.price_flag(F.col("a"), F.col("c")).alias("f")).collect()
    return [r.f for r in sorted(out, key=lambda r: r.i)]


def test_either_limit_alerts(spark):
    rows = [
        (0, 100000.0, 97000.0), (1, 100000.0, 96999.0), (2, 1000.0, 900.0), (3, 1000.0, 899.0),
        (4, 0.0, 5.0), (5, None, 5.0), (6, 5.0, None), (7, 5.0, 0.0), (8, 5.0, 50.0),
    ]
    assert _flag(spark, rows) == ["✅", "❗", "✅", "❗", "", "", "", "", "✅"]


def test_same_price_and_installment_reference(spark):
    rows = [
        (0, None, None, None, None), (1, 5.0, None, 5.0, 5.0), (2, 5.0, 6.0, 5.0, 5.0),
        (3, 5.0, 0.0, 5.0, 5.0), (4, 5.0, 6.0, 5.0, 0.0), (5, 5.0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, ac double, ai double, c double, n double")
    same = P.same_price(F.col("ac"), F.col("ai"), F.col("c"), F.col("n"))
    out = df.select("i", same.alias("s")).collect()
    # Row 3: an anchor installment of zero is a reference, it does not fall back to cash.
    assert [r.s for r in sorted(out, key=lambda r: r.i)] == [
        True, True, False, False, True, False,
    ]


def test_format_price(apply):
    prices = [359000.0, 1234.5, 0.0, None, 999.0, 1234567.0005, 12.3456]
    assert apply(R.format_price, prices, "double") == [
        "359\u00a0000", "1\u00a0234.5", "—", "—", "999", "1\u00a0234\u00a0567.001", "12.346",
    ]
    assert apply(lambda c: R.format_price(c, "."), [359000.0], "double") == ["359.000"]


def test_alert_key(apply):
    messages = ["12. *iPhone 15*\nAnchor - 5", "*iPhone 15*\nx", "3.\u00a0 *A* \ny"]
    assert apply(R.alert_key, messages) == ["*iPhone 15*", "*iPhone 15*", "*A*"]


def test_sim_classes(apply):
    # "esim + esim" holds "sim + esim", so the second rule takes it.
    assert apply(L.catalog_sim_suffix, ["eSIM", "esim + esim", "2 eSIM", "dual esim + nano", None]) == [
        " eSim", " Nano-Sim", " eSim", " Nano-Sim", "",
    ]
    assert apply(L.modifier_sim, ["1 SIM", "a+b", "E-SIM", "dual", "Global"]) == [
        "nanosim", "nanosim", "esim", "dualsim", None,
    ]
    assert apply(L.option_sim, ["2 eSIM", "x/eSIM", " e sim ", "Other"]) == [
        "eSim+eSim", "Nano-Sim", "eSim", "Other",
    ]


def test_labels(apply):
    assert apply(L.storage_label, ["256 ԳԲ", "8 գբ", "1 ՏԲ ", "128 GB"]) == [
        "256GB", "8GB", "1TB", "128GB",
    ]
    assert apply(L.strip_prefix, ["Գնել Poco", "գնել  Poco", "Poco Գնել x"]) == [
        "Poco", "Poco", "Poco Գնել x",
    ]
    assert apply(lambda c: L.absolute_url(c, "https://s"), ["/a", "https://b/c"]) == [
        "https://s/a", "https://b/c",
    ]


def test_schedule(spark):
    times = [f"2024-01-01 {h:02d}:30:00" for h in range(24)]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(
        F.col("t").cast("timestamp").alias("t")
    )
    utc = [r.c for r in df.select(run_class(F.col("t")).alias("c")).collect()]
    assert utc[2] == "collect" and utc[5] == "full" and utc[4] == "idle" and utc[20] == "idle"
    assert utc[6:20] == ["new_only"] * 14
    local = [r.c for r in df.select(class_of_local(F.col("t")).alias("c")).collect()]
    assert local[6] == "collect" and local[9] == "full" and local[23] == "new_only"
