"""Sessions and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("loomspan")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LOOMSPAN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir. Only where that is unset, a folder of this machine."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="loomspan-")
        atexit.register(shutil.rmtree, _OWN_DIR[app], ignore_errors=True)
    return _OWN_DIR[app]


#: Tables written so far by each application, to be deleted by clear.
_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, name: str, folder: str | None = None, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder, or to folder, and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder
    if path is None:
        path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes this application's intermediate tables and tells how many; for when no DataFrame that stands on them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to executors whose Python path lacks it; to be called once on such a cluster."""
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:  # of the driver, which serves it
        out = Path(folder) / f"{root.name}.zip"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p in root.rglob("*.py"):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(out))
