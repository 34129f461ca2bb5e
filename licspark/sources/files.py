"""Corpus files."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def _root(spark: SparkSession, path: str) -> str:
    """Full name of a folder, or of the folder of a file, as Spark writes it in front of the files below it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(context._jsc.hadoopConfiguration())
    place = store.makeQualified(place)
    if store.exists(place) and store.getFileStatus(place).isFile():
        place = place.getParent()
    return place.toString().rstrip("/")


def read_files(spark: SparkSession, path: str, pattern: str | None = None, base: str | None = None) -> DataFrame:
    """All files under a folder (or one file): path, n_bytes, content bytes.

    Paths are relative to ``base`` (default: the folder read), as findings name them;
    a file outside of ``base`` keeps its full name. Listing alone reads no content,
    since the column is pruned when unused.
    """
    root = _root(spark, base or path) + "/"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    full = F.col("path")
    relative = F.when(F.startswith(full, F.lit(root)), F.substring(full, len(root) + 1, 1 << 30)).otherwise(full)
    return reader.load(path).select(relative.alias("path"), F.col("length").alias("n_bytes"), F.col("content").alias("data"))


def latin1_text(data):
    """Bytes to text, one character per byte, so every file can be read."""
    return F.decode(data, "ISO-8859-1")


def read_contents(spark: SparkSession, path: str, pattern: str | None = None, base: str | None = None) -> DataFrame:
    """Files with their text; paths are relative to ``base`` (default: the folder read)."""
    return read_files(spark, path, pattern, base).select("path", "n_bytes", latin1_text(F.col("data")).alias("content"))


def with_content(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Attach contents by path; files without content keep a null."""
    return files.join(contents.select("path", "content"), "path", "left")


def missing_content(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Files whose content cannot be read."""
    return files.join(contents.select("path"), "path", "left_anti")
