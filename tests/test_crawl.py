from collections import deque

from pyspark.sql import functions as F

from webloom.operators import crawl, joins

EDGES = [("s", "b"), ("s", "c"), ("b", "c"), ("c", "s"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "y"), ("b", "b")]


def breadth_first(edges, seed, limit):
    seen, queue = {}, deque([(seed, 0)])
    while queue:
        node, depth = queue.popleft()
        if node in seen:
            continue
        seen[node] = depth
        if not limit or depth <= limit:
            queue += [(b, depth + 1) for a, b in edges if a == node]
    return seen


def test_reachable(spark):
    edges = spark.createDataFrame([("d", a, b) for a, b in EDGES], "target_domain string, src_url string, dst_url string")
    seeds = spark.createDataFrame([("d", "s")], "target_domain string, url string")
    for limit in (0, 1, 2):
        rows = crawl.reachable(edges, seeds, limit).collect()
        assert {r.url: r.depth for r in rows} == breadth_first(EDGES, "s", limit)
        assert all(r.processed == (limit == 0 or r.depth <= limit) for r in rows)


def test_sites_do_not_mix(spark):
    edges = spark.createDataFrame([("d", "s", "b"), ("e", "b", "z")], "target_domain string, src_url string, dst_url string")
    seeds = spark.createDataFrame([("d", "s")], "target_domain string, url string")
    assert {r.url for r in crawl.reachable(edges, seeds).collect()} == {"s", "b"}


def test_status_and_stats(spark):
    reached = spark.createDataFrame(
        [("d", "https://d/a", 0, True), ("d", "https://d/b?x=1", 1, True), ("d", "https://d/c", 2, False)],
        "target_domain string, url string, depth int, processed boolean",
    )
    stored = spark.createDataFrame([("d", "a.html")], "target_domain string, path string")
    status = crawl.with_status(reached, stored)
    assert {(r.url, r.status) for r in status.collect()} == {("https://d/a", "present"), ("https://d/b?x=1", "missing")}
    assert [r.path for r in crawl.missing_urls(reached, stored).orderBy("url").collect()] == ["b@x=1.html", "c.html"]
    assert crawl.crawl_stats(status, with_total=True).count() == 4


def test_content_type_decides_edges(page_table, sheet_table):
    pages = page_table(("a.html", '<a href="/x">'), ("feed.xml", '<a href="/y">'))
    sheets = sheet_table(("a.css", '@import "b.css";'))
    assert {r.dst_url for r in crawl.crawl_edges(pages, sheets).collect()} == {
        "https://example.com/x", "https://example.com/b.css",
    }


def test_running_total_on_one_large_group(spark):
    """Nearly all rows in one group: equal to a window over the group."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("g"),
        F.format_string("%06d", F.pmod(F.col("id") * 7919, F.lit(3000))).alias("k"),
        (F.col("id") % 13).alias("v"),
    )
    ours = {(r.g, r.k): r.t for r in joins.running_total(rows, ["g"], ["k"], F.col("v"), "t").collect()}
    expected, totals = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.g, r.k)):
        totals[r.g] = totals.get(r.g, 0) + r.v
        expected[(r.g, r.k)] = totals[r.g]
    assert ours == expected


def test_tiles_equal_ntile(spark):
    rows = spark.range(47).select(F.when(F.col("id") < 44, "a").otherwise("b").alias("g"), F.col("id").alias("k"))
    rows.createOrReplaceTempView("tile_rows")
    expected = spark.sql("SELECT g, k, ntile(5) OVER (PARTITION BY g ORDER BY k) AS t FROM tile_rows").collect()
    assert set(map(tuple, joins.tiles(rows, ["g"], ["k"], 5, "t").collect())) == set(map(tuple, expected))


def test_politeness_with_jitter(spark):
    urls = spark.createDataFrame([("d", f"u{n}", n % 3) for n in range(20)], "target_domain string, url string, depth int")
    rows = crawl.politeness_schedule(urls, 1000, crawl.jitter_permille(F.col("url"))).orderBy("depth", "url").collect()
    steps = [b.start_ms - a.start_ms for a, b in zip(rows, rows[1:])]
    assert rows[0].start_ms == 0 and all(500 <= s <= 1500 for s in steps)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_round_moves_only_what_it_finds(spark):
    """Edges keep their layout, and what is found is aggregated before and after its exchange."""
    from webloom.session import cut_lineage

    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in (0, a + 1)], "src long, dst long")
    outgoing = cut_lineage(pairs.repartition(2, "src").sortWithinPartitions("src"), keep_layout=True)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    frontier = cut_lineage(spark.range(40).select(F.col("id").alias("node")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(crawl.newly_found(frontier, outgoing))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x for x in plan.splitlines() if "Exchange" in x or "HashAggregate" in x]
    kinds = ["Exchange" if "Exchange" in x else "Aggregate" for x in lines]
    # From the top: final aggregate, exchange, partial aggregate; below, only the frontier is moved to the edges.
    assert kinds == ["Aggregate", "Exchange", "Aggregate", "Exchange"] and "SortMergeJoin" in plan


def test_a_url_that_a_third_of_all_pages_link_to(spark):
    """No task after the numbering reads more than a row of it for each task before."""
    n = 6000
    edges = spark.range(n).select(
        F.lit("d").alias("target_domain"),
        F.format_string("u%d", "id").alias("src_url"),
        F.explode(F.array(F.format_string("u%d", F.col("id") * 2 + 1), F.format_string("u%d", F.col("id") * 2 + 2),
                          F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.lit("u0")))).alias("dst_url"),
    )
    seeds = spark.createDataFrame([("d", "u0")], "target_domain string, url string")
    urls, pairs, start = crawl.numbered(edges, seeds)
    assert start.count() == 1 and urls.count() == urls.select("node").distinct().count() == 2 * n + 2
    assert pairs.count() == 3 * n
    found = crawl.newly_found(urls.select("node"), pairs)
    wide = found._jdf.queryExecution().executedPlan().toString()
    assert wide.index("HashAggregate") < wide.index("Exchange hashpartitioning(node") < wide.rindex("HashAggregate")
    depth = {r.url: r.depth for r in crawl.reachable(edges, seeds).collect()}
    assert len(depth) == 2 * n + 2 and depth["hot"] == 1 and depth["u0"] == 0 and depth["u6"] == 2


def test_bitmaps(spark):
    def step(numbers, state):
        found = spark.createDataFrame([(x,) for x in numbers], "node long")
        out = crawl.unseen(found, state)
        return sorted(r.node for r in out.where("node is not null").collect()), out

    high = 5 << crawl.PLACE_BITS
    first, state = step([0, 7, 8, high + 100], None)
    assert first == [0, 7, 8, high + 100]
    second, state = step([8, 9, high + 3, (1 << crawl.PLACE_BITS) + 1], state)
    assert second == [9, (1 << crawl.PLACE_BITS) + 1, high + 3]
    third, state = step([], state)
    assert third == [] and state.where("bits is not null").count() == 3
    assert step([0, 1, 7, 9, high + 3, high + 100], state)[0] == [1]


def test_long_chain(spark):
    """Many rounds, so that their tables are merged."""
    edges = [("d", f"n{k}", f"n{k + 1}") for k in range(20)] + [("d", f"n{k}", "n0") for k in range(20)]
    rows = crawl.reachable(
        spark.createDataFrame(edges, "target_domain string, src_url string, dst_url string"),
        spark.createDataFrame([("d", "n0")], "target_domain string, url string"),
    ).collect()
    assert {r.url: r.depth for r in rows} == {f"n{k}": k for k in range(21)}


def test_figures(spark):
    reached = spark.createDataFrame(
        [("d", "https://d/a", 0, True), ("d", "https://d/b", 1, True), ("d", "https://d/c", 1, True),
         ("d", "https://d/e", 1, True), ("d", "https://d/f", 2, False)],
        "target_domain string, url string, depth int, processed boolean",
    )
    stored = spark.createDataFrame([("d", "a.html")], "target_domain string, path string")
    log = spark.createDataFrame(
        [("d", "https://d/b", 0), ("d", "https://d/c", 4), ("d", "https://d/c", 5)],
        "target_domain string, url string, status int",
    )
    row = crawl.crawl_figures(reached, stored, log).first()
    assert (row.visited, row.cached, row.downloaded, row.failed) == (5, 1, 1, 1)
