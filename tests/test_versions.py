"""The store with history: whole versions, runs that die, as-of reads, expiry."""

import pytest
from pyspark.sql import functions as F

from pricelens.plans import runs
from pricelens.sources import versions

ROW = "name string, cash_price double, installment_price double, source string, ord array<bigint>"


def offers(spark, *rows):
    full = [(n, p, None, s, [i]) for i, (s, n, p) in enumerate(rows)]
    return spark.createDataFrame(full, ROW)


def write(spark, store, at, *rows):
    stamp = f"2024-03-{at:02d} 12:00:00"
    return versions.write_version(offers(spark, *rows), store, F.lit(stamp).cast("timestamp"), f"{stamp}+00:00")


def state(df):
    return sorted((r.source, r.name, r.cash_price) for r in df.collect())


@pytest.fixture
def store(tmp_path):
    return str(tmp_path / "store")


def test_versions_and_what_runs_see(spark, store):
    assert versions.read_version(spark, store) is None
    assert versions.history(spark, store).count() == 0
    assert write(spark, store, 1, ("anchor", "x", 1.0), ("shop_b", "y", 2.0)) == 1
    assert write(spark, store, 3, ("anchor", "z", 3.0)) == 2
    assert state(versions.read_version(spark, store, 1)) == [("anchor", "x", 1.0), ("shop_b", "y", 2.0)]
    assert state(versions.read_version(spark, store)) == [("anchor", "z", 3.0), ("shop_b", "y", 2.0)]
    times = spark.createDataFrame([(d,) for d in (0, 1, 2, 3, 9)], "d int").select(
        (F.lit("2024-03-01 12:00:00").cast("timestamp") + F.make_dt_interval(days=F.col("d") - 1)).alias("run"))
    seen = versions.offers_seen(spark, store, times)
    got = sorted((r.run.day, r.version, r.source, r.name) for r in seen.collect() if r.run.month == 3)
    first, second = [(1, "anchor", "x"), (1, "shop_b", "y")], [(2, "anchor", "z"), (2, "shop_b", "y")]
    assert got == [(d, *v) for d, vs in ((1, first), (2, first), (3, second), (9, second)) for v in vs]
    before = times.where("d = 0")
    assert versions.offers_seen(spark, store, before) is None
    with pytest.raises(ValueError, match="not in the store"):
        versions.read_version(spark, store, 7)


def test_a_failed_write_is_never_seen(spark, store):
    write(spark, store, 1, ("anchor", "x", 1.0))
    with pytest.raises(Exception, match="unknown source"):
        write(spark, store, 2, ("anchor", "new", 1.0), ("nobody", "y", 2.0))
    assert state(versions.read_version(spark, store)) == [("anchor", "x", 1.0)]
    assert write(spark, store, 3, ("shop_c", "w", 4.0)) == 2
    removed = versions.expire(spark, store, keep=5, grace_hours=0)
    assert len(removed) == 1  # the folder of the failed write
    assert state(versions.read_version(spark, store)) == [("anchor", "x", 1.0), ("shop_c", "w", 4.0)]


def test_two_runs_that_end_together(spark, store, monkeypatch):
    write(spark, store, 1, ("anchor", "x", 1.0))
    stamp = F.lit("2024-03-02").cast("timestamp")
    mine = versions.stage(offers(spark, ("shop_b", "mine", 1.0)), store, stamp)
    real, calls = versions.current, []

    def slow(spark_, store_, number=None):
        found = real(spark_, store_, number)
        calls.append(found.number)
        if len(calls) == 1:  # another run publishes between our reading and our writing
            monkeypatch.setattr(versions, "current", real)
            write(spark, store, 2, ("shop_b", "theirs", 2.0), ("shop_c", "theirs", 2.0))
            monkeypatch.setattr(versions, "current", slow)
        return found

    monkeypatch.setattr(versions, "current", slow)
    assert versions.publish(spark, store, mine, "2024-03-02 13:00:00+00:00") == 3
    monkeypatch.setattr(versions, "current", real)
    assert calls == [1, 2]
    assert state(versions.read_version(spark, store)) == [
        ("anchor", "x", 1.0), ("shop_b", "mine", 1.0), ("shop_c", "theirs", 2.0)]
    assert state(versions.read_version(spark, store, 2))[1] == ("shop_b", "theirs", 2.0)


def test_expiry_keeps_what_versions_share(spark, store):
    write(spark, store, 1, ("anchor", "x", 1.0), ("shop_b", "y", 2.0))
    for day in (2, 3, 4):
        write(spark, store, day, ("anchor", f"x{day}", 1.0))
    assert versions.expire(spark, store, keep=2) == []  # too young
    removed = versions.expire(spark, store, keep=2, grace_hours=0)
    assert len(removed) == 1  # of the first versions only the second one's folder is unused
    assert state(versions.read_version(spark, store, 3)) == [("anchor", "x3", 1.0), ("shop_b", "y", 2.0)]
    assert write(spark, store, 5, ("anchor", "x5", 1.0)) == 5
    assert versions.publish(spark, store, {"anchor": None, "shop_b": None}, "2024-03-06 00:00:00+00:00") == 6
    assert versions.read_version(spark, store) is None
    assert versions.history(spark, store).where("version = 6").count() == 1


class Killed(BaseException):
    """The driver is gone: nothing catches this."""


def test_run_from_jobs_to_report(spark, tmp_path, monkeypatch):
    store, reports = str(tmp_path / "store"), str(tmp_path / "reports")
    anchor = ("anchor", "Phone 1", 20000.0), ("anchor", "Phone 2", 20000.0)

    def jobs(*competitor, broken=False):
        def failing():
            raise OSError("no pages")

        rows = [("shop_b", n, p) for n, p in competitor]
        return {
            "anchor": lambda: offers(spark, *anchor),
            "shop_b": failing if broken else lambda: offers(spark, *rows),
        }

    def run(day, job, **more):
        found = runs.pages_to_report(spark, job, store, reports, f"2024-03-0{day} 12:00:00+00:00", **more)
        return sorted((r.n, r.product_key) for r in found.collect())

    assert run(1, jobs(("Phone 1", 10000.0))) == [(1, "phone 1")]
    assert run(2, jobs(("Phone 1", 10000.0), ("Phone 2", 9000.0))) == [(2, "phone 2")]
    # The driver dies between the jobs and the version, then inside the report.
    with monkeypatch.context() as m:
        m.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            run(3, jobs(("Phone 1", 1.0)))
    assert versions.current(spark, store).number == 2
    with monkeypatch.context() as m:
        m.setattr(runs, "report", lambda *a: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            run(3, jobs(("Phone 2", 9000.0)))
    assert versions.current(spark, store).number == 3
    # The next run compares with the last whole report; a broken shop keeps its offers.
    assert run(4, jobs(broken=True), new_only=False) == [(1, "phone 2")]
    assert run(5, jobs(("Phone 1", 10000.0))) == [(1, "phone 1")]
    # Giving a report again changes nothing.
    again = runs.report_version(spark, store, reports, new_only=True)
    assert sorted((r.n, r.product_key) for r in again.collect()) == [(1, "phone 1")]


def test_no_offers_no_report(spark, tmp_path):
    store = str(tmp_path / "store")
    found = runs.pages_to_report(
        spark, {"anchor": lambda: offers(spark)}, store, str(tmp_path / "r"), "2024-03-01 00:00:00+00:00")
    assert found is None
    assert versions.current(spark, store).number == 0
