"""Folders of saved sites as tables, and tables back to folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators.rewrite import numbered_failures
from webloom.sources import folders


def inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """All files below a folder: (path, length); contents are not read."""
    return folders.listed(spark, folder, glob)


def texts(
    spark: SparkSession, folder: str, glob: str, column: str, with_empty: bool = False
) -> DataFrame:
    """Text files as (path, <column>); invalid bytes are dropped, and empty files if not asked for."""
    found = folders.contents(spark, folder, folders.listed(spark, folder, glob), column)
    return found if with_empty else found.where(F.col(column) != "")


def read_pages(spark: SparkSession, folder: str, target_domain: str) -> DataFrame:
    """``*.html`` and ``*.htm`` files of one site as a page table."""
    found = texts(spark, folder, "*.{html,htm}", "html")
    return found.select(
        F.xxhash64(F.lit(target_domain), "path").alias("page_id"),
        U.page_address(F.lit(target_domain), F.col("path")).alias("url"),
        F.lit(target_domain).alias("target_domain"),
        "path",
        "html",
    )


def read_stylesheets(spark: SparkSession, folder: str, target_domain: str) -> DataFrame:
    """``*.css`` files of one site; an empty one can be imported, so it is there too."""
    found = texts(spark, folder, "*.css", "css", with_empty=True)
    return found.select(
        F.lit(target_domain).alias("target_domain"),
        "path",
        U.page_address(F.lit(target_domain), F.col("path")).alias("url"),
        "css",
    )


def changed_only(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.where(~F.col(new).eqNullSafe(F.col(old)))


def write_changed(df: DataFrame, old: str, new: str, folder: str) -> None:
    """Append the rows whose text differs; unchanged rows cause no output."""
    changed_only(df, old, new).write.mode("append").parquet(folder)


def write_back(df: DataFrame, old: str, new: str, folder: str) -> int:
    """Write changed texts to the files they came from (``path`` below ``folder``); number of files written."""
    return folders.write_texts(changed_only(df, old, new), new, folder)


def write_url_list(urls: DataFrame, folder: str) -> None:
    """One URL per line."""
    urls.select("url").write.mode("overwrite").text(folder)


def last_failure_number(spark: SparkSession, folder: str) -> int:
    """Highest number in a quarantine table; 0 if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0
    row = spark.read.parquet(folder).agg(F.max(F.col("number").cast("int")).alias("n")).first()
    return row["n"] or 0


def quarantine(failures: DataFrame, keys: list[str], folder: str) -> None:
    """Append rejected rewrites under running numbers that continue in the folder.

    One writer at a time: two of them would read the same last number.
    """
    spark = failures.sparkSession
    numbered = numbered_failures(failures, keys, last_failure_number(spark, folder))
    numbered.write.mode("append").parquet(folder)
