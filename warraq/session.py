"""Session and table helpers shared by the operators."""

from __future__ import annotations

import functools
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "warraq", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    import os

    package_parent = str(Path(__file__).resolve().parent.parent)
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (package_parent, os.environ.get("PYTHONPATH", "")) if x)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers on every executor.

    On a cluster the package is usually installed or passed by --py-files; where
    it is not, a zip of it is added once to the application.
    """
    sc = spark.sparkContext
    if getattr(sc, "_warraq_shipped", False):
        return
    import zipfile

    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="warraq-")) / "warraq_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path("warraq") / p.relative_to(here)))
    sc.addPyFile(str(target))
    sc._warraq_shipped = True


def shipped(query):
    """A query that first makes the package importable on the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for tables of a query, beside the checkpoints in the shared folder."""
    import uuid

    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    The folder is the one named in spark.checkpoint.dir. Only where none is set
    and the master is local (tests), a temporary one is used.
    """
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="warraq-checkpoint-"))
    return sc.getCheckpointDir()
