"""Tables written to the folder that all executors share, so that loops keep short plans and lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in local tests, a folder is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/plans/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def appended(df: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, str]:
    """The rows added to a table of the shared folder, and its path: a loop that adds rows writes each of them once."""
    path = path or f"{shared_folder(df.sparkSession)}/plans/{name}-{uuid.uuid4().hex}"
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(*tables: DataFrame) -> None:
    """Delete saved() tables that nothing will read again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def numbered(df: DataFrame, *order: str, name: str = "numbered", start: int = 0) -> DataFrame:
    """The rows with a long seq from start on that follows the order: a range-partitioned sort, saved, and the number of rows in
    the parts before; only as many numbers as there are parts come to the driver."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = saved(rows.withColumns({"_part": F.spark_partition_id(), "_local": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)
    sizes, base, firsts = dict(rows.groupBy("_part").count().collect()), start, []
    for part in range(max(sizes, default=0) + 1):
        firsts.append(base)
        base += sizes.get(part, 0)
    place = F.col("_local") + F.element_at(F.array(*(F.lit(x).cast("long") for x in firsts)), F.col("_part") + 1)
    return rows.withColumn("seq", place).drop("_part", "_local")
