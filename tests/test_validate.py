from webloom.operators import validate

GOOD = "<html><head></head><body><p>readable text</p></body></html>"
CASES = {
    GOOD: [],
    "<html><body><p>readable text</p></body></html>": ["missing_head"],
    "<html><header></header><body>readable text</body></html>": [],
    "<html><head></head><p>readable text</p></html>": ["missing_body"],
    "<html><head></head><body></body></html>": ["empty_body"],
    "<HTML><HEAD></HEAD><BODY class='x'>ab</BODY></HTML>": ["empty_body"],
    "<html><head></head><body><script>long script text</script><style>p{color:red}</style><!-- long comment --></body>": ["empty_body"],
    "<html><head></head><body>a<b>b</b>c&nbsp;</body></html>": [],
    GOOD + "\x00": ["has_binary_content"],
    GOOD + "\x7f": ["has_binary_content"],
    GOOD + "\t\r\n": [],
    "\x01": ["missing_head", "missing_body", "has_binary_content"],
}


def test_pages(page_table):
    checked = validate.check_pages(page_table(*[(f"{n}.html", t) for n, t in enumerate(CASES)]))
    for row, issues in zip(checked.orderBy("page_id").collect(), CASES.values(), strict=True):
        assert [n for n in validate.ISSUES if row[n]] == issues
        assert row.valid == (not issues)


def test_empty_page_is_invalid_without_issue(page_table):
    row = validate.check_pages(page_table(("a.html", ""))).first()
    assert not row.valid and not any(row[n] for n in validate.ISSUES)


def test_site_results(page_table):
    bad = [("d", f"{n}.html", "<body>some readable text") for n in range(8)]
    checked = validate.check_pages(page_table(*bad, ("e", "ok.html", GOOD)))
    verdict = {r.target_domain: r for r in validate.site_verdict(checked).collect()}
    assert verdict["e"].all_valid and not verdict["d"].all_valid and verdict["d"].missing_head == 8
    preview = validate.issue_preview(validate.issue_rows(checked)).orderBy("rank").collect()
    assert [r.path for r in preview] == [f"{n}.html" for n in range(5)] and preview[0].more == 3


def test_preview_ranks_before_the_shuffle(page_table):
    checked = validate.check_pages(page_table(("d", "a.html", "x")))
    plan = validate.issue_preview(validate.issue_rows(checked))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
