"""Sending alerts: bad messages fail alone, and nothing is sent twice."""

import pytest

from pricelens.sources import alerts


@pytest.fixture
def rows(spark):
    data = [("r1", f"p{i}", f"message {i}") for i in range(20)] + [("r1", "p3", "message 3 again"), ("r1", "p20", None)]
    return spark.createDataFrame(data, "run string, product_key string, message string").repartition(4)


def messenger(folder, bad):
    """Appends a line to a file for every message; fails for some of them."""

    def send(row):
        if row["product_key"] in bad or row["message"] is None:
            raise ConnectionError(f"no route for {row['product_key']}")
        with open(f"{folder}/{row['product_key']}", "a") as out:
            out.write("x")

    return send


def test_bad_messages_fail_alone_and_are_tried_again(spark, rows, tmp_path):
    sent, path = tmp_path / "sent", str(tmp_path / "deliveries")
    sent.mkdir()
    assert alerts.deliveries(spark, path) is None and alerts.failures(spark, path) is None
    first = alerts.deliver(rows, path, messenger(sent, {"p1", "p2"}))
    assert first.count() == 21  # one of two equal keys
    assert {r.product_key for r in first.where("status = 'failed'").collect()} == {"p1", "p2", "p20"}
    listed = {r.product_key: (r.attempts, r.error) for r in alerts.failures(spark, path).collect()}
    assert listed["p1"] == (1, "ConnectionError: no route for p1") and len(listed) == 3
    second = alerts.deliver(rows, path, messenger(sent, {"p2"}), attempt=2)
    assert {(r.product_key, r.status) for r in second.collect()} == {("p1", "sent"), ("p2", "failed"), ("p20", "failed")}
    assert alerts.deliver(rows, path, messenger(sent, set()), attempt=3).where("status = 'sent'").count() == 1
    listed = {r.product_key: r.attempts for r in alerts.failures(spark, path).collect()}
    assert listed == {"p20": 3}
    assert sorted(p.name for p in sent.iterdir()) == sorted(f"p{i}" for i in range(20))
    assert all(p.read_text() == "x" for p in sent.iterdir())  # each message once


def test_another_run_is_another_message(spark, rows, tmp_path):
    from pyspark.sql import functions as F

    sent, path = tmp_path / "sent", str(tmp_path / "deliveries")
    sent.mkdir()
    alerts.deliver(rows, path, messenger(sent, set()))
    again = alerts.deliver(rows.withColumn("run", F.lit("r2")), path, messenger(sent, set()))
    assert again.where("status = 'sent'").count() == 20
    assert alerts.deliver(rows.limit(0), path, messenger(sent, set())).count() == 0
