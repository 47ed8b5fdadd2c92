"""Sources and sinks: tables in, model cards and summaries out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_READERS = {".csv": "csv", ".tsv": "csv", ".dat": "csv", ".parquet": "parquet", ".orc": "orc", ".json": "json"}


def read_table(data, spark: SparkSession | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A DataFrame from a path (by its ending) or the DataFrame itself.

    CSV files have a header; tabs separate in .tsv and .dat files.  A schema spares the
    pass that infers one.  Other endings raise ValueError, other types TypeError.
    """
    if isinstance(data, DataFrame):
        return data
    if not isinstance(data, str):
        raise TypeError("data must be a DataFrame or a path")
    ending = next((e for e in _READERS if data.lower().rstrip("/").endswith(e)), None)
    if ending is None:
        raise ValueError(f"cannot tell how to read {data}; known endings: {', '.join(_READERS)}")
    spark = spark or SparkSession.getActiveSession()
    reader = spark.read
    if ending in (".csv", ".tsv", ".dat"):
        reader = reader.option("header", True).option("sep", "," if ending == ".csv" else "\t")
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(data)
    return (reader.schema(schema) if schema is not None else reader).format(_READERS[ending]).load(data)


#: Rows that one task sorts, groups or packs, about.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` (of about so many ``rows``) dealt out by ``keys``, to so many tasks that the share of one does not grow with the table.

    A table that Spark's own number of tasks serves well enough is left to that, as it may then join small ones.
    To more tasks than Spark writes a file each for, a whole input split is first sorted in memory; up to four times
    as many, larger shares take less than that.
    """
    tasks = -(-rows // TASK_ROWS)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    direct = int(df.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if direct < tasks <= 4 * direct:
        tasks = direct
    return df.repartition(tasks, *keys) if tasks > usual else df.repartition(*keys)


def write_card(spark: SparkSession, card: dict, path: str) -> None:
    """A model card (plain values) as JSON, by Spark's writer, wherever the path points."""
    if not isinstance(path, str):
        raise ValueError("the path must be a string")
    spark.createDataFrame([(json.dumps(card),)], "card string").coalesce(1).write.mode("overwrite").text(path)


def read_card(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))
