"""Reading the corpus tables by a path that any Spark file system resolves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts that go to a Python worker at once.
BATCH_ROWS = 1024
#: Up to so many 64-bit ids are broadcast to pick their rows; beyond, the rows are shuffled.
BROADCAST_IDS = 2_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends at most ``BATCH_ROWS`` rows at once to Python from now on.

    The default of 10,000 rows is meant for short rows; of whole texts it holds tens of megabytes in the executor and
    again in each worker. A smaller value of the session's own is kept.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ROWS)) <= BATCH_ROWS:
        conf.set(ROWS, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
