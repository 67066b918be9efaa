"""What all of the library needs from a session: its package on the executors, and tables in the folder that they share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_folio_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="folio-")) / "folio_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "folio").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._folio_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a fresh local folder serves a local
    master; on a cluster that would lose rows, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(sc, "_folio_shared", None)
        if not found:
            found = sc._folio_shared = tempfile.mkdtemp(prefix="folio-shared-")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing. The
    table goes when the session ends, or with sweep() once no plan reads it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not hasattr(sc, "_folio_tables"):
        sc._folio_tables = {}
        atexit.register(_forget_all, spark)
    # every plan made from the table shares its relation, so the table is needed as long as that lives
    relation = out._jdf.queryExecution().analyzed().collectLeaves().head().relation()
    sc._folio_tables[path] = sc._jvm.java.lang.ref.WeakReference(relation)
    return out


def sent(written: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table, to be broadcast if it has at most so many rows. Spark would find that out as well, but deal out the other side of the join meanwhile."""
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written


def temporary(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for this session's own use; what is there goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget_quietly, spark, path)
    return path


def sweep(spark: SparkSession) -> None:
    """Deletes the tables of materialize() that no plan reads any more, and lets Spark delete shuffle files that nothing refers to; both
    show when the driver's JVM collects garbage."""
    sc = spark.sparkContext
    gc.collect()
    sc._jvm.System.gc()
    known = getattr(sc, "_folio_tables", {})
    for path in [p for p, held in known.items() if held.get() is None]:
        del known[path]
        _forget(spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget_quietly(spark: SparkSession, path: str) -> None:
    try:
        _forget(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def _forget_all(spark: SparkSession) -> None:
    for path in spark.sparkContext._folio_tables:
        _forget_quietly(spark, path)
