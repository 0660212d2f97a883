"""Pages are read again only if they changed."""

from pyspark.sql import functions as F

from pricelens.session import scratch_path
from pricelens.streaming.pages import current_rows, stream_changed_pages

PAGE = "url string, stored_at int, html string"


def test_only_changed_pages_are_read(spark, tmp_path):
    source, root = str(tmp_path / "pages"), scratch_path(spark, "t")
    read = spark.sparkContext.accumulator(0)

    def run(*rows):
        if rows:
            spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(source)
        before = read.value
        stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(source)

        def parse(pages):
            found = pages.select("url", F.upper("html").alias("text"))
            read.add(found.count())
            return found

        stream_changed_pages(stream, parse, root, f"{root}/cp").awaitTermination()
        now = {r.url: r.text for r in current_rows(spark, root).collect()}
        return read.value - before, now

    assert run(("a", 1, "x"), ("b", 1, "y"), ("b", 1, "y"), ("b", 0, "old"), (None, 1, "z"), ("c", 1, None)) == (
        2, {"a": "X", "b": "Y"})
    assert run(("a", 2, "x"), ("b", 2, "y2"), ("d", 2, "w")) == (2, {"a": "X", "b": "Y2", "d": "W"})
    assert run(("b", 1, "late"), ("a", 3, "x")) == (0, {"a": "X", "b": "Y2", "d": "W"})
    assert run(("b", 4, "y"), ("b", 5, "y2")) == (0, {"a": "X", "b": "Y2", "d": "W"})  # the newest is the known one
    assert run() == (0, {"a": "X", "b": "Y2", "d": "W"})
    assert run(("a", 9, "")) == (1, {"a": "", "b": "Y2", "d": "W"})
