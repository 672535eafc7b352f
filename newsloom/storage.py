"""Tables, and intermediate results that outlive executors.

Lineage is cut with files in the folder that ``spark.checkpoint.dir`` names, which every executor and the driver
share. A local folder is chosen only where that setting is absent and the master is local.
"""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read lazily; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="newsloom-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/newsloom-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder now."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Spark's own setting: the shuffle files of a query go when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Of queries that run in here no shuffle file stays behind; the session's own setting holds again after it."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, tag: str, free: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors lose nothing.

    The shuffle files of the job go when it ends. Those of other jobs go when the driver collects its garbage, so that
    is asked for here: on a large driver it could be long until then, and the files would fill the executors' disks.
    Small results of an iteration pass ``free=False``; what they leave goes with the next large one.
    """
    path = fresh_path(df.sparkSession, tag)
    jvm = df.sparkSession.sparkContext._jvm
    if free:
        jvm.System.gc()  # what the caller let go of since the last result
    with shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    if free:
        jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of results of ``materialize`` that nothing will read any more."""
    for frame in frames:
        if frame is not None and getattr(frame, "_written_to", None):
            remove(frame.sparkSession, frame._written_to)


def _fs(spark: SparkSession, path: str) -> tuple:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [s.getPath().toString() for s in fs.listStatus(at)] if fs.exists(at) else []


def state(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """Length and time of the files behind some tables: what is kept by it is not used for other data."""
    out = []
    for name in names:
        fs, at = _fs(spark, f"{sf_dir}/{name}.parquet")
        out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)]
    return tuple(sorted(out))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside ``path`` and rename it over: readers see the old text or the new one."""
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _fs(spark, path)[1].toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fs, at = _fs(spark, f"{path}-{uuid.uuid4().hex}")
    stream = fs.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(at, _fs(spark, path)[1], options)
