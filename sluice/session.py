"""Session factory, and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the queries assume; conf overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(master).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package: as --py-files would, once a session, unless PYTHONPATH already has it."""
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if ROOT in on_path or getattr(sc, "_sluice_shipped", False):
        return
    to = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="sluice-"), "sluice_package.zip"))
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((ROOT / "sluice").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(to)
    sc._sluice_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own if unset.

    A private temporary folder is used only by a local master, where driver
    and executors are one process; otherwise the warehouse folder serves.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if path:
        return path.rstrip("/")
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    local = sc.master.startswith("local") and "cluster" not in sc.master
    path = f"file://{tempfile.mkdtemp(prefix='sluice-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    sc.setCheckpointDir(path)
    return path


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what queries have written for themselves in the shared folder; to be called when their results have been used. Whether there was any."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sluice")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
