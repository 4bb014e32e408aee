"""Files that a query writes first, in the folder that all tasks share."""

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

RENAME_THREADS = 16


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; below a fresh local one only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="workload-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_text_files(texts: DataFrame, path: str, extension: str, one_each: bool = False) -> None:
    """Text files with an extension of their own, one line per row, or one file per row.

    Spark names text files ``.txt``, so they are renamed: by many threads, as each rename waits for the file system.  With one file
    per row the rows are dealt over the tasks of a shuffle first, and tasks move their files into place themselves.
    """
    spark = texts.sparkSession
    if one_each:
        dealt = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        writer = dealt.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    else:
        writer = texts.write
    writer.text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = hadoop.FileUtil.stat2Paths(files.listStatus(folder))

    def rename(number: int) -> None:
        name = paths[number].getName()
        if name.endswith(".txt") and not files.rename(paths[number], hadoop.Path(folder, name[:-4] + extension)):
            raise OSError(f"could not rename {name} in {path}")

    with ThreadPoolExecutor(RENAME_THREADS) as pool:
        for _ in pool.map(rename, range(len(paths))):
            pass
