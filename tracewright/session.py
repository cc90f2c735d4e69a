"""Session defaults and durable intermediate tables.

Intermediate results that must not be recomputed (range partitions, rounds of an
iteration) are written to the folder all executors share, so the loss of an
executor costs a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_left: list[tuple[SparkSession, str]] = []


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracewright")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    The cluster names it in spark.checkpoint.dir. Only a session that runs in
    one local process may fall back to a folder of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tracewright-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns the table.

    The path is in the attribute `written_to` of the result, for `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tw-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path  # type: ignore[attr-defined]
    return out


def freed(df: DataFrame, name: str) -> DataFrame:
    """As `written`, and the shuffle files of the write go with it, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def discard(df: DataFrame | None) -> None:
    """Deletes a table that `written` made; nothing that is still to be read may need it."""
    path = getattr(df, "written_to", None)
    if path is None:
        return
    _delete(df.sparkSession, path)
    _left[:] = [x for x in _left if x[1] != path]


def release() -> int:
    """Deletes all tables that `written` made and nobody discarded, and returns their number.

    For sessions that run many queries: to be called when the results of the
    queries so far have been read or saved.
    """
    gone = list(_left)
    for spark, path in gone:
        _delete(spark, path)
    _left[:] = [x for x in _left if x not in gone]
    return len(gone)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
