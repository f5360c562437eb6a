"""Session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders by application, where the cluster names none.
_OWN: dict[str, str] = {}


def local_session(app: str = "driftline", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests on
    one machine) a temporary folder is made, one for each application.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        if name not in _OWN:
            _OWN[name] = tempfile.mkdtemp(prefix="driftline-")
        path = _OWN[name]
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session may be gone at exit; the folder's owner then clears it
        pass


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in a folder for each value of ``by`` if given, and read it back.

    This cuts the lineage: a lost executor costs a read of these files, not a second run of all that came before. The
    files are removed when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove the files of materialised tables that no later plan reads: whatever was made from them is written too.

    The plans that made these tables are done as well. Spark drops their shuffle files once the driver's garbage is
    collected, which it otherwise does every half hour; so ask for that now.
    """
    for table in tables:
        _remove(table.sparkSession, table._folder)
    if tables:
        tables[0].sparkSession._jvm.System.gc()
