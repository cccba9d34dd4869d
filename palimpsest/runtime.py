"""Session helpers: where intermediate tables live, and how lineage is cut.

Iterative operators write each round as a Parquet table in the shared folder named by
``spark.checkpoint.dir``.  A written table survives the loss of any executor, stores columns
compressed, and gives the next stage a clean lineage.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode where the session names
    none.  A cluster without one is an error: executors share no machine's folder."""
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY) or getattr(sc, "_palimpsest_folder", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = sc._palimpsest_folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return folder.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one operator run, under one folder of the shared store.

    ``keep`` writes a frame and returns it re-read; ``drop`` removes a table that no pending
    plan reads any more (the previous round of an iteration).
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/palimpsest/{label}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._n = 0

    def keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        weakref.finalize(back, self._paths.pop, id(back), None)
        return back

    def drop(self, df: DataFrame | None) -> None:
        path = self._paths.pop(id(df), None) if df is not None else None
        if path:
            delete_path(self.spark, path)

    def clear(self, but: tuple[DataFrame, ...] = ()) -> None:
        """Delete the tables of the run, all but the named ones, and let the session drop the shuffle
        files of plans that are done."""
        kept = {self._paths[id(df)].rsplit("/", 1)[-1] for df in but}
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not kept:
            fs.delete(root, True)
        else:
            for status in fs.listStatus(root):
                if status.getPath().getName() not in kept:
                    fs.delete(status.getPath(), True)
        gc.collect()
        jvm.System.gc()


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, once."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="palimpsest-code-")) / "palimpsest.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(home.rglob("*.py")):
            z.write(source, Path(home.name) / source.relative_to(home))
    sc.addPyFile(str(archive))
    sc._palimpsest_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
