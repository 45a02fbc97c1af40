"""Session helpers: a local session for tests, table reading, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "docketry-"
_SHIPPED: set[str] = set()


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "docketry") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DOCKETRY_DRIVER_MEMORY", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship_code(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application: they need not have it installed or on a path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix=_PREFIX)  # of the driver, which serves the file
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(Path(folder) / "docketry.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(Path(folder) / "docketry.zip"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship_code(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or a local one where it is unset and the
    master is local. A machine-local folder is refused on a cluster."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix=_PREFIX)
        spark.sparkContext.setCheckpointDir(at)
    return at


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        pass


class Files:
    """Small texts and folder names through Hadoop, in whatever file system a path names."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def read(self, path: str) -> str | None:
        """The text of a file, None if there is none."""
        where, fs = self._at(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replaces a file as a whole: written beside it, then renamed over it."""
        where, fs = self._at(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(path + ".next")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), self._conf)
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self._jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        options[0] = overwrite
        context.rename(context.makeQualified(beside), context.makeQualified(where), options)

    def names(self, path: str) -> list[str]:
        where, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def remove(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)


_MADE: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that materialize() wrote within it: for long sessions, around a query and the writing of
    its result. Results that were not written are not readable afterwards."""
    first = len(_MADE)
    try:
        yield
    finally:
        while len(_MADE) > first:
            _remove(spark, _MADE.pop())


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, is compressed and columnar,
    and stays readable when executors are lost. The table is removed at the end of scratch(), else of the process."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{_PREFIX}{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Remove a table written by materialize() as soon as nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{_PREFIX}" in folder:
            _remove(spark, folder)
