"""Tables a job writes once and reads several times.

A staged table cuts the lineage: the steps after it plan and recover from files in the shared
folder, so a lost executor costs the tasks it was running and never the steps before.  Being
Parquet, it is read column by column and its size is known to the optimizer.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession


class Staging:
    """Staged tables of one job run, in a folder of their own.

    The folder is ``folder``, or a new one in the folder that ``spark.checkpoint.dir`` names.  Whoever
    opened it deletes it once the job's results are written: at the end of a ``with`` block, by ``delete``,
    or when the application ends, which is arranged here.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        if folder is None:
            shared = spark.conf.get("spark.checkpoint.dir", None)
            if not shared:
                raise ValueError("give a folder all executors share, or name one in spark.checkpoint.dir")
            folder = f"{shared.rstrip('/')}/lapwise-{uuid.uuid4().hex}"
        self.folder = folder
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        self._files = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.deleteOnExit(self._path)

    def __enter__(self) -> "Staging":
        return self

    def __exit__(self, *_) -> None:
        self.delete()

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it read back, with the same schema."""
        df.write.mode("errorifexists").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def delete(self) -> None:
        self._files.delete(self._path, True)
