import pytest
from pyspark.sql import functions as F

from checks.registry import QUERIES
from webloom.streaming import jobs

SCHEMA = "page_id bigint, url string, target_domain string, ts timestamp, html string"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).withColumn(
        "ts", F.to_timestamp("ts")
    ).select("page_id", "url", "target_domain", "ts", "html").coalesce(1).write.mode("append").parquet(folder)


def page(n, minute, *links):
    body = "".join(f'<a href="{x}">' for x in links)
    return (n, f"https://d.org/{n}", "d.org", f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", body)


def test_missing_urls_over_two_runs(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stored = spark.createDataFrame([("d.org", "1.html")], "target_domain string, path string")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        jobs.start_missing_urls(jobs.discovered_urls(stream), stored, out, state).awaitTermination()
        return sorted(r.url for r in spark.read.parquet(out).collect())

    arrive(spark, source, [page(1, 0, "/1", "/2", "/2#x"), page(2, 1, "/2", "/3")])
    assert run() == ["https://d.org/2", "https://d.org/3"]
    # Long after the watermark has forgotten the first links.
    arrive(spark, source, [page(9, 600, "/3", "/4")])
    arrive(spark, source, [page(10, 1200, "/2", "/4")])
    assert run() == ["https://d.org/2", "https://d.org/3", "https://d.org/4"]


def test_no_batch_reads_what_an_earlier_one_wrote(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    nothing = spark.createDataFrame([], "target_domain string, path string")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        found = jobs.discovered_urls(stream, late=None)
        query = jobs.start_missing_urls(found, nothing, out, state)
        query.awaitTermination()
        return query

    def files():
        return set((tmp_path / "out").glob("*.parquet"))

    arrive(spark, source, [page(n, n, "/hot", f"/{n}", "/hot#x") for n in range(40)])
    query = run()
    assert spark.read.parquet(out).count() == 41
    metrics = query.lastProgress["stateOperators"][0]
    assert metrics["numRowsTotal"] == 41 and any("rocksdb" in k for k in metrics["customMetrics"])
    # The hot URL is one row for each task when it reaches the state, not one for each page.
    assert metrics["customMetrics"]["numDroppedDuplicateRows"] < 8
    first = files()
    for file in first:
        file.write_bytes(b"cannot be read")
    arrive(spark, source, [page(100, 100, "/hot", "/7", "/new")])
    run()
    new = files() - first
    assert [r.url for f in new for r in spark.read.parquet(str(f)).collect()] == ["https://d.org/new"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none").endswith(("none", "HDFSBackedStateStoreProvider"))


def test_issue_counts_equal_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    arrive(spark, source, [page(n, n) for n in range(60)])
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    jobs.start_counts(jobs.issue_counts(stream), out, state).awaitTermination()
    batch = jobs.issue_counts(spark.read.schema(SCHEMA).parquet(source))
    assert set(map(tuple, jobs.current_counts(spark, out).collect())) == set(map(tuple, batch.collect()))
    # More pages of the last window change its count.
    arrive(spark, source, [page(n, 59) for n in range(100, 105)])
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    jobs.start_counts(jobs.issue_counts(stream), out, state).awaitTermination()
    assert set(map(tuple, jobs.current_counts(spark, out).collect())) == set(map(tuple, batch.collect()))


@pytest.mark.parametrize("name", ["stream_issue_counts", "stream_page_verdicts", "stream_missing_urls"])
def test_queries_over_a_file_and_over_a_folder_of_files(spark, tmp_path, name):
    body = "<html><head></head><body>{}<a href='/x'>x</a></body></html>"
    rows = [(n, f"https://d.org/{n}", body.format(n) if n % 3 else f"<p>{n}") for n in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "many" / "pages.parquet"))
    pages.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "one").mkdir()
    (found,) = (tmp_path / "made").glob("*.parquet")
    (tmp_path / "one" / "pages.parquet").write_bytes(found.read_bytes())
    many, one = (sorted(map(tuple, QUERIES[name](spark, str(tmp_path / d)).collect()), key=str) for d in ("many", "one"))
    assert many == one != []
