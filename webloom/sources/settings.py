"""Settings files (JSON, with comments in ``.jsonc``) as rows over defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.operators.media import MEDIA_EXTENSIONS

_TEXTS = T.ArrayType(T.StringType())
# Key in the file, column, type, default.
FIELDS = (
    ("UserAgent", "user_agent", T.StringType(), "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36"),
    ("Timeout", "timeout", T.IntegerType(), 15),
    ("Retries", "retries", T.IntegerType(), 3),
    ("MaxDepth", "max_depth", T.IntegerType(), 0),
    ("OutputRoot", "output_root", T.StringType(), "./downloads"),
    ("WaitBetweenRequests", "wait_between_requests", T.DoubleType(), 0.5),
    ("ParallelDownloads", "parallel_downloads", T.IntegerType(), 2),
    ("RejectPatterns", "reject_patterns", _TEXTS, []),
    ("RejectDomains", "reject_domains", _TEXTS, []),
    ("MediaExtensions", "media_extensions", _TEXTS, list(MEDIA_EXTENSIONS)),
)
FILE_SCHEMA = T.StructType([T.StructField(key, kind) for key, _, kind, _ in FIELDS])


def _literal(value, kind):
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def with_defaults(raw: DataFrame) -> DataFrame:
    """File columns renamed, missing values filled."""
    return raw.select(
        *[
            F.coalesce(F.col(key), _literal(default, kind)).alias(column)
            for key, column, kind, default in FIELDS
        ]
    )


def to_file_keys(settings: DataFrame) -> DataFrame:
    return settings.withColumnsRenamed({column: key for key, column, _, _ in FIELDS})


def default_settings(spark: SparkSession) -> DataFrame:
    return with_defaults(spark.createDataFrame([tuple(None for _ in FIELDS)], FILE_SCHEMA))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_settings(spark: SparkSession, path: str | None = None, folder: str = ".") -> DataFrame:
    """One settings row.  Unknown keys are ignored; a missing or broken file gives the defaults.

    Without a path, ``settings.jsonc`` of the folder is preferred to ``settings.json``.
    """
    if path is None:
        names = [f"{folder.rstrip('/')}/settings.{end}" for end in ("jsonc", "json")]
        path = next((n for n in names if _exists(spark, n)), names[0])
    if not _exists(spark, path):
        return default_settings(spark)
    comments = str(path.endswith(".jsonc")).lower()
    schema = T.StructType([*FILE_SCHEMA, T.StructField("_broken", T.StringType())])
    raw = spark.read.schema(schema).json(
        path, multiLine=True, allowComments=comments, columnNameOfCorruptRecord="_broken"
    )
    sound = F.col("_broken").isNull()
    return with_defaults(raw.select(*[F.when(sound, F.col(k)).alias(k) for k, *_ in FIELDS]))
