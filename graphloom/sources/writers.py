"""Writers: JSON lines, tables, separated values, text, and routed splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, key: str | None = None) -> None:
    """A keyed table as Parquet; rows of one key lie together."""
    (df.repartitionByRange(F.col(key)).sortWithinPartitions(key) if key else df).write.mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Without header."""
    df.write.mode("overwrite").csv(path)


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Rows by their ``split`` into one folder each; rows marked ``mini`` once more into ``mini``."""
    df.drop("mini").write.mode("overwrite").partitionBy("split").json(path)
    df.where("mini").drop("mini", "split").write.mode("overwrite").json(f"{path}/mini")
