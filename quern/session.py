"""Session helpers: a local session for tests and the shared staging folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quern")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read and write.

    It is the session's ``spark.checkpoint.dir``. Where that is unset (tests on
    one machine) a temporary folder is made once and used by this session only.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has already ended; the folder is the cluster's to clear
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end of ``staging``, or when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/quern-{uuid.uuid4().hex}/{name}"
    if _open:
        _open[-1].append(path.rpartition("/")[0])
    atexit.register(_remove, spark, path.rpartition("/")[0])
    return path


#: Paths of the tables staged in each open ``staging``.
_open: list[list[str]] = []


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end: for sessions that run many queries. Results must be read or written inside."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _remove(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: work before this point isn't repeated when an executor is
    lost, and several readers don't compute it several times.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it by PYTHONPATH or the working folder."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    seen = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."] if p}
    if root in seen or app in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="quern-code-")) / "quern.zip"  # read by the driver only, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((root / "quern").rglob("*.py")):
            z.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
