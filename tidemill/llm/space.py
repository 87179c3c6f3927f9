"""Shared-folder tables that cut lineage, checked broadcasts and reading of the input tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.tokens import slices

#: A side of a join is broadcast if its rows, counted, come to no more than this.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, as in local tests, one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again, so that a lost executor costs no recomputing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a written() table that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def checked(side: DataFrame, row_bytes: int = 24, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The side marked for broadcast if its counted rows fit the limit, else as it is, for a shuffled join."""
    return F.broadcast(side) if side.count() * row_bytes <= limit else side


def only(docs: DataFrame, text: Column, mask: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs for whose text the mask is true. The texts alone go to Python, and a flag for each comes back."""

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [mask(part.column(0)) for part in slices(pa.record_batch([batch], names=["text"]))]
            yield pa.array(np.concatenate([*parts, np.zeros(0, bool)]))

    return docs.filter(run(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels_of(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """One row for each labelled document: doc_id and, as label, the column's greatest value."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col(column).cast("int").alias("label"))
    return rows.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
