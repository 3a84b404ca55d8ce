"""Session defaults and the shared folder that holds staged tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# Distinct-id state of a long stream outgrows the heap; RocksDB spills to disk.
DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    STATE_STORE: DISK_STATE,
}


def get_session(app_name: str = "inferlake", master: str | None = None,
                conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_disk_state(spark: SparkSession) -> None:
    """For streams started from a session that ``get_session`` did not make."""
    spark.conf.set(STATE_STORE, DISK_STATE)


def shared_base(spark: SparkSession) -> str:
    """The folder every executor sees: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="inferlake-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never reused."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


_SCOPE: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def temporary_stages(spark: SparkSession):
    """Staged tables made inside are deleted at the end; for work whose result is
    written out before that."""
    token = _SCOPE.set([])
    try:
        yield
    finally:
        made = _SCOPE.get()
        _SCOPE.reset(token)
        for path in made:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    there, so losing an executor never recomputes what lies before."""
    path = shared_path(df.sparkSession, name)
    if _SCOPE.get() is not None:
        _SCOPE.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
