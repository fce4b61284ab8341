"""Session helpers: local session, table access and lineage cuts."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Spark's own file server copies it to every executor, so none needs it installed.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="graphloom-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path(here.name) / p.relative_to(here)))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``checkpoint()`` into the folder that the session names in ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs on this machine alone (tests, laptops).
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, *by: str) -> DataFrame:
    """The rows, written once as a table in the checkpoint folder: compressed, and without the constraints that a checkpoint carries on.

    In partitions by the given columns a part can be read alone.
    """
    path = f"{_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffles_freed(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """While ``f`` runs, shuffle files go as soon as the table they were for is written, not when the driver happens to collect its garbage.

    The first argument of ``f`` is a DataFrame, whose session's setting is as before afterwards.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @functools.wraps(f)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        conf = df.sparkSession.conf
        before = conf.get(name)
        conf.set(name, "true")
        try:
            return f(df, *args, **kwargs)
        finally:
            conf.set(name, before)

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    how: str = "inner",
    hot_rows: int = 200_000,
    salt_from: Column | None = None,
) -> DataFrame:
    """Equi-join on ``key`` that spreads the hot keys of ``big`` over several tasks.

    ``small`` has few rows per key. Keys with more than ``hot_rows`` rows in ``big`` get
    ``ceil(rows / hot_rows)`` salts; the rows of ``small`` for these keys are repeated once per salt.
    At most ``rows / hot_rows`` keys can be hot, so the repeated part is bounded by the same figure.
    """
    counts = (
        big.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).select(key, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__salts"))
    )
    salt = F.coalesce(F.col("__salts"), F.lit(1))
    left = big.join(counts, key, "left").withColumn("__salt", F.pmod(salt_from if salt_from is not None else F.xxhash64(*big.columns), salt).cast("int")).drop("__salts")
    right = small.join(counts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salt - 1))).drop("__salts")
    return left.join(right, [key, "__salt"], how).drop("__salt")
