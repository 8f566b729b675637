import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from webloom.session import build_session, name_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    name_folder(session, str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a function of text columns for each row of arguments."""

    def run(function, rows):
        from pyspark.sql import functions as F

        rows = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        names = [f"c{n}" for n in range(len(rows[0]) - 1)]
        df = spark.createDataFrame(rows, ["i", *names])
        out = df.select("i", function(*[F.col(n) for n in names]).alias("v")).collect()
        return [r.v for r in sorted(out, key=lambda r: r.i)]

    return run


@pytest.fixture
def page_table(spark):
    def build(*pages):
        """Pages as (path, html) of site example.com, or (domain, path, html)."""
        rows = []
        for n, page in enumerate(pages):
            domain, path, text = page if len(page) == 3 else ("example.com", *page)
            rows.append((n, f"https://{domain}/{path}", domain, path, text))
        return spark.createDataFrame(
            rows, "page_id bigint, url string, target_domain string, path string, html string"
        )

    return build


@pytest.fixture
def sheet_table(spark):
    def build(*sheets):
        rows = [("example.com", path, f"https://example.com/{path}", css) for path, css in sheets]
        return spark.createDataFrame(rows, "target_domain string, path string, url string, css string")

    return build
