import json

import pytest
from pyspark.sql import functions as F

from webloom.operators import report, rewrite
from webloom.sources import files, folders, settings


def test_folder_scan(spark, tmp_path):
    site = tmp_path / "site"
    (site / "sub").mkdir(parents=True)
    (site / "a.html").write_bytes("é�".encode())
    (site / "sub" / "b.htm").write_bytes(b"x\xffy")
    (site / "empty.html").write_bytes(b"")
    (site / "c.css").write_text("p{}")
    (site / "d.txt").write_text("no")
    pages = {r.path: r for r in files.read_pages(spark, str(site), "d.org").collect()}
    assert {p: r.html for p, r in pages.items()} == {"a.html": "é�", "sub/b.htm": "xy"}
    assert pages["sub/b.htm"].url == "https://d.org/sub/b.htm"
    (site / "no rules@x%2F.css").write_text("")
    sheets = {r.path: r.css for r in files.read_stylesheets(spark, str(site), "d.org").collect()}
    assert sheets == {"c.css": "p{}", "no rules@x%2F.css": ""}
    assert {(r.path, r.length) for r in files.inventory(spark, str(site)).collect()} == {
        ("a.html", 5), ("sub/b.htm", 3), ("c.css", 3), ("d.txt", 2), ("empty.html", 0), ("no rules@x%2F.css", 0),
    }


def test_listing_is_no_local_relation(spark, tmp_path):
    """Folders are the partitions; neither a list of paths nor a file index stands in the plan."""
    for k in range(90):
        (tmp_path / f"d{k}" / "_deep" / ".x").mkdir(parents=True)
        (tmp_path / f"d{k}" / "_deep" / ".x" / "p {a}.css").write_text("a" * k)
    (tmp_path / "top.css").write_text("é")
    (tmp_path / "top.cssx").write_text("no")
    found = files.inventory(spark, str(tmp_path), "*.css")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "BatchScan webloom_folder" in plan
    assert found.rdd.getNumPartitions() > 60
    want = {(f"d{k}/_deep/.x/p {{a}}.css", k) for k in range(90)} | {("top.css", 2)}
    assert set(map(tuple, found.collect())) == want
    assert files.texts(spark, str(tmp_path), "*.css", "css").count() == 90
    assert files.texts(spark, str(tmp_path), "*.css", "css", with_empty=True).count() == 91


def test_one_folder_with_most_files(spark, tmp_path):
    """Contents are dealt by file, not by folder."""
    for k in range(300):
        (tmp_path / f"{k}.css").write_text(str(k))
    found = folders.contents(spark, str(tmp_path), folders.listed(spark, str(tmp_path)), "css")
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 2 and max(r["count"] for r in sizes) < 200
    assert {r.path: r.css for r in found.collect()} == {f"{k}.css": str(k) for k in range(300)}


def test_globs_and_missing_folder(spark, tmp_path):
    fits = folders.name_test("*.{html,htm}")
    assert fits.match("a.html") and fits.match(".htm") and not fits.match("a.xhtml.b") and not fits.match("a.HTML")
    with pytest.raises(Exception, match="FileNotFoundError"):
        files.inventory(spark, str(tmp_path / "gone")).count()


def test_write_back(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a/b.html", "old", "new é"), ("c.html", "same", "same"), ("n.html", "x", None)],
        "path string, html string, new_html string",
    )
    folder = str(tmp_path / "site")
    assert folders.write_texts(rows, "html", folder) == 3
    before = (tmp_path / "site" / "c.html").stat().st_mtime_ns
    assert files.write_back(rows, "html", "new_html", folder) == 1
    assert (tmp_path / "site" / "a" / "b.html").read_text() == "new é"
    assert (tmp_path / "site" / "c.html").stat().st_mtime_ns == before
    assert {r.path for r in files.inventory(spark, folder).collect()} == {"a/b.html", "c.html", "n.html"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, None, "c")], "id int, old string, new string")
    assert sorted(r.id for r in files.changed_only(df, "old", "new").collect()) == [2, 3]
    out = str(tmp_path / "changed")
    files.write_changed(df, "old", "new", out)
    assert spark.read.parquet(out).count() == 2
    urls = spark.createDataFrame([("https://a",), ("https://b",)], "url string")
    files.write_url_list(urls, str(tmp_path / "failures"))
    assert {r.value for r in spark.read.text(str(tmp_path / "failures")).collect()} == {"https://a", "https://b"}


def test_quarantine_continues(spark, page_table, tmp_path):
    steps = [rewrite.RewriteStep("body", "</body>")]
    done = rewrite.run_steps(page_table(("a.html", "<body>x</body>"), ("b.html", "<body>y</body>")), "html", steps, rewrite.html_error)
    failed, out = rewrite.failure_rows(done, ["path"]), str(tmp_path / "q")
    files.quarantine(failed, ["path"], out)
    files.quarantine(failed, ["path"], out)
    assert sorted(r.number for r in spark.read.parquet(out).collect()) == ["00001", "00002", "00003", "00004"]


def load(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return settings.load_settings(spark, str(tmp_path / name)).first()


def test_settings(spark, tmp_path):
    default = settings.default_settings(spark).first()
    assert default.timeout == 15 and default.wait_between_requests == 0.5 and len(default.media_extensions) == 16
    text = '{ // note\n "Timeout": 30, /* x */ "_Internal": {"a": 1}, "RejectPatterns": ["http://x", "b"] }'
    row = load(spark, tmp_path, "s.jsonc", text)
    assert row.timeout == 30 and row.reject_patterns == ["http://x", "b"] and row.retries == 3
    assert load(spark, tmp_path, "s.json", text) == default
    assert load(spark, tmp_path, "bad.json", '{"Timeout": 30') == default
    assert settings.load_settings(spark, str(tmp_path / "absent.json")).first() == default
    keys = settings.to_file_keys(settings.default_settings(spark)).columns
    assert keys[0] == "UserAgent" and len(keys) == 10


def test_jsonc_is_preferred(spark, tmp_path):
    (tmp_path / "settings.json").write_text(json.dumps({"Timeout": 1}))
    assert settings.load_settings(spark, folder=str(tmp_path)).first().timeout == 1
    (tmp_path / "settings.jsonc").write_text(json.dumps({"Timeout": 2}))
    assert settings.load_settings(spark, folder=str(tmp_path)).first().timeout == 2


def test_report(one, spark):
    cases = {0: "0 bytes", 1023: "1023 bytes", 1024: "1.00 KB", 1536: "1.50 KB", 101504: "99.12 KB", 1048576: "1.00 MB", 5368709120: "5.00 GB"}
    assert one(lambda c: report.format_size(c.cast("bigint")), list(cases)) == list(cases.values())
    stored = spark.createDataFrame([("d", "a", 1000), ("d", "b", 48)], "target_domain string, path string, length bigint")
    log = spark.createDataFrame([("d", "x", 0), ("d", "y", 4)], "target_domain string, url string, status int")
    row = report.site_totals(stored, log).first()
    assert (row.files, row.bytes, row.failed, row["size"]) == (2, 1048, 1, "1.02 KB")
    assert report.site_totals(stored).first().failed == 0
    span = report.duration(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:01:30").cast("timestamp"))
    assert spark.range(1).select(span.cast("string").alias("s")).first().s == "INTERVAL '0 00:01:30' DAY TO SECOND"
