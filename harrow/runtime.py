"""What jobs of several steps need from the session: the package on the executors, checkpoints, tidy disks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHIPPED: set[str] = set()
#: Has Spark delete the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their search path has it or it is installed."""
    root = Path(__file__).resolve().parents[1]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if "site-packages" in root.parts or str(root) in map(os.path.abspath, known) or spark.sparkContext.applicationId in SHIPPED:
        return
    SHIPPED.add(spark.sparkContext.applicationId)
    folder = tempfile.mkdtemp(prefix="harrow-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "harrow.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "harrow").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; make a local one only where the master is local and names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="harrow-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage; survives lost executors.

    The shuffle files of the plan are deleted as soon as it is materialised: nothing reads them again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting holds for plans made from here on
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def discard(*frames: DataFrame) -> None:
    """Delete the checkpoint files of frames that nothing will read again."""
    for df in frames:
        rdd = df._jdf.queryExecution().analyzed().rdd()
        name = rdd.getCheckpointFile()
        if name.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

