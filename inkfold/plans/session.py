"""Session helpers: shipping this package to executors, and tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_MADE: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package to the executors' Python path, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_inkfold_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="inkfold-")  # the driver's own: Spark copies the archive to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "inkfold.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, str(path.relative_to(_PACKAGE.parent)))
    sc.addPyFile(archive)
    sc._inkfold_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on a single machine (as in tests) a folder of our own is made; on a
    cluster a missing setting is an error, as no other folder is known to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        base = f"/tmp/checkpoints/inkfold-{os.getpid()}"
        os.makedirs(base, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``release`` removes it."""
    if not _MADE:
        atexit.register(release, spark)
    _MADE.append(f"{shared_dir(spark)}/inkfold/{name}-{uuid.uuid4().hex[:12]}")
    return _MADE[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it again.

    Cuts the lineage with files that outlive any executor, and gives the planner true
    sizes, so that it alone decides whether a side is small enough to broadcast.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[str, DataFrame] = {}


def kept(spark: SparkSession, key: str, make) -> DataFrame:
    """The table that ``make()`` gave for this key before, or gives now: written once for an application and options key.

    So a change of what only follows it (the pages' arrangement, say) doesn't extract pages anew.
    """
    own = f"{spark.sparkContext.applicationId}|{key}"
    if own not in _KEPT:
        _KEPT[own] = written(make(), "kept")
    return _KEPT[own]


def release(spark: SparkSession) -> int:
    """Deletes all tables that this application has put into the shared folder; returns how many.

    To be called when results that read them have been written; the end of the application calls it too.
    """
    done, sc = 0, spark.sparkContext
    _KEPT.clear()
    if sc._jsc is None:
        return 0
    while _MADE:
        path = sc._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        done += bool(path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True))
    return done
