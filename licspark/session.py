"""Session services shared by the operators: intermediate tables in the folder all executors share."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for stored steps and streams, read from spark.checkpoint.dir.

    Where it is unset, a session that runs inside one process (``local[n]``) gets
    a folder of its own; any other session is refused, since its executors and
    driver need one folder that all of them reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        _OWN[application] = tempfile.mkdtemp(prefix="licspark-")
    return _OWN[application]


_OWN: dict[str, str] = {}


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/licspark/{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, name: str) -> str:
    """Fresh path for an intermediate table; the application's tables go when its Python driver ends."""
    folder = _application_folder(spark)
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(release, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_FOLDERS: set[str] = set()


def release(spark: SparkSession, folder: str | None = None) -> None:
    """Delete the intermediate tables of this application; results that read them must be written before."""
    folder = folder or _application_folder(spark)
    _FOLDERS.discard(folder)
    context = spark.sparkContext
    if context._jsc is None:
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which survives lost executors.

    Unlike a checkpoint, later steps read only the columns they need, and Spark
    knows the size of the table when it plans joins.
    """
    path = new_table_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
