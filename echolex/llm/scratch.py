"""Where intermediate tables go, so that a lost executor costs a re-read and not a recomputation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000
_own: dict[str, str] = {}  # application -> local folder; local mode only
_cuts: dict[int, tuple[DataFrame, str]] = {}  # by the identity of the frame, which is held here
_name = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only in local mode, where one machine has all
    folders, an unset name gives a temporary folder of our own, deleted at exit; elsewhere it is an error."""
    named = spark.sparkContext.getConf().get(_name) or spark.conf.get(_name, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_name} must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="spark-cuts-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
    return _own[app]


def cut(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends here.

    ``instead_of``: an earlier cut that nothing but ``df`` reads; it is deleted once ``df`` is written."""
    path = f"{shared_dir(df.sparkSession)}/cut-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _cuts[id(out)] = (out, path)
    if instead_of is not None:
        drop(instead_of)
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a cut that nothing will read again."""
    _, path = _cuts.pop(id(df), (None, None))
    if path:
        _delete(df.sparkSession, path)


def mark() -> set[int]:
    """The cuts made so far, for ``drop_since``."""
    return set(_cuts)


def drop_since(before: set[int], keep: DataFrame) -> None:
    """Deletes all cuts made since ``mark`` but ``keep``, which was written from them."""
    for key in [k for k in _cuts if k not in before and k != id(keep)]:
        drop(_cuts[key][0])


def clear(spark: SparkSession) -> None:
    """Deletes all cuts of this process, for when its results are written. Frames that read them are void then."""
    for _, path in _cuts.values():
        _delete(spark, path)
    _cuts.clear()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def arrow_rows(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, and with them a Python worker's memory on long texts. One bound holds for all
    operators, so that none changes another's plan; one that the session sets itself stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS or int(spark.conf.get(setting)) <= 0:
        spark.conf.set(setting, str(BATCH_ROWS))
