"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a small side, once counted, is broadcast; above it joins shuffle.
BROADCAST_ROWS = 20_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; set one only where none is configured and the session is local (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.sparkContext.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared checkpoint folder, so that lost executors cost no recomputation.

    A written table, unlike ``checkpoint()``, also drops the constraints that the optimizer has inferred;
    in iterative plans they multiply until planning takes longer than the work.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete saved tables that everything built on them has been read from; what is derived from a table is no table."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.__dict__.pop("_saved_at"))
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def hinted(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark an already saved ``small`` for broadcast if its counted rows are within ``rows``."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once even where ``body`` uses it inside the lambda of another function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; translate is slow, so pure ASCII takes the plain way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_of(docs: DataFrame) -> Column:
    """The text column, null as empty."""
    return F.coalesce(docs["text"], F.lit(""))
