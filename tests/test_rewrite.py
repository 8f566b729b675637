import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webloom.operators import rewrite
from webloom.operators.rewrite import RewriteStep

PAGE = "<html><head></head><body>one</body></html>"


def test_guard_reverts_and_goes_on(page_table):
    steps = [
        RewriteStep("head", "</head>"),
        RewriteStep("nothing", "absent", "x"),
        RewriteStep("word", "one", "two"),
        RewriteStep("body", "</?body>"),
        RewriteStep("function", F.upper),
        RewriteStep("delete", "TWO"),
    ]
    done = rewrite.run_steps(page_table(("a.html", PAGE)), "html", steps, rewrite.html_error)
    row = done.first()
    assert row.new_text == PAGE.upper().replace("ONE", "") and row.steps_applied == 3
    failures = rewrite.failure_rows(done, ["path"]).orderBy("step_no").collect()
    assert [(f.step, f.error) for f in failures] == [
        ("head", "HTML validation failed: missing </head>"),
        ("body", "HTML validation failed: missing <body>, missing </body>"),
    ]
    assert failures[0].content == PAGE.replace("</head>", "") and failures[0].pattern == "</head>"
    numbers = rewrite.numbered_failures(rewrite.failure_rows(done, ["path"]), ["path"], 41)
    assert sorted(r.number for r in numbers.collect()) == ["00042", "00043"]


def test_css_guard(sheet_table):
    steps = [RewriteStep("all", "(?s).+", "  "), RewriteStep("b", "b", "c")]
    row = rewrite.run_steps(sheet_table(("a.css", "a{b}")), "css", steps, rewrite.css_error).first()
    assert row.new_text == "a{c}" and row.steps_applied == 1 and row.failures[0].error == "CSS content is empty"


def test_python_step(page_table):
    @F.pandas_udf(StringType())
    def swap(text: pd.Series) -> pd.Series:
        return text.str.replace("one", "1")

    row = rewrite.run_steps(page_table(("a.html", PAGE)), "html", [RewriteStep("p", swap)], rewrite.html_error).first()
    assert row.new_text == PAGE.replace("one", "1") and row.steps_applied == 1


def test_plan_does_not_grow_with_steps(page_table):
    def size(n):
        steps = [RewriteStep(f"s{i}", f"x{i}", f"y{i}") for i in range(n)]
        done = rewrite.run_steps(page_table(("a.html", PAGE)), "html", steps, rewrite.html_error)
        return len(done.where("steps_applied > 0")._jdf.queryExecution().optimizedPlan().toString())

    assert size(8) < 2.5 * size(4)


def test_a_sheet_of_blanks_is_empty(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a{}", "\xa0　\n"), ("a{}", " b "), ("a{}", "")], "old string, new string")
    found = [r.e for r in df.select(rewrite.css_error(F.col("old"), F.col("new")).alias("e")).collect()]
    assert found == ["CSS content is empty", None, "CSS content is empty"]
