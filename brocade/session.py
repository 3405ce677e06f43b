"""Session helpers: a local session for tests, and where lineage may be cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and local benches; on a cluster the session is given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brocade")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, so that they need no copy of
    their own. Spark's file server on the driver hands the archive out."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="brocade-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; only where it is
    unset and the master is local, set a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="brocade-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """df written once and read back, see `keep`; `scratch` deletes the table at the end of its block."""
    path, table = keep(df)
    for tables in _SCOPES:
        tables.append(path)
    return table


def keep(df: DataFrame) -> tuple[str, DataFrame]:
    """df written once, as a parquet table in the shared checkpoint folder, and read from there.

    A lost executor then costs no recomputation, later plans see one fixed set of rows, and each of them
    reads only the columns it uses. (DataFrame.checkpoint would compute df twice and keep whole rows.) The tables of
    an application lie in one folder, which goes when the application ends. With its path, for tables that several
    queries share."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tables/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a folder of the shared file system still exists."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or "/nowhere")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


_FOLDERS: set[str] = set()
_SCOPES: list[list[str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system; nothing to do once the session is gone."""
    try:
        sc = spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - at the end of a process there may be no JVM left to ask
        pass


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that `cut` wrote inside, for a query whose result has been written when the block ends."""
    tables: list[str] = []
    _SCOPES.append(tables)
    try:
        yield
    finally:
        _SCOPES.remove(tables)
        for path in tables:
            _remove(spark, path)
