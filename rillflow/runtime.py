"""Session facts the operators rely on: shared checkpoint folder and partition counts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the session has, else `spark.checkpoint.dir`, else (local master only) a temporary one."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rillflow-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs read the stored rows, in the same partitions, even after an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes a core; inputs smaller than this times the cores are spread before work that is heavy a row.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input, which may lie in one file and so in one task, over all cores. Larger inputs have tasks enough and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that they needn't share the driver's folders."""
    sc = spark.sparkContext
    if getattr(sc, "_rillflow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="rillflow-package-"), "rillflow.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith((".py", ".npz")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("rillflow", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._rillflow_shipped = True
