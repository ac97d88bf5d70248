"""Frame helpers of the corpus operators: input columns, shared scratch tables, joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a written table.

    It lies in the shared folder of ``spark.checkpoint.dir``.  Only a local session without that
    setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="skymesh-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: bytes of an Arrow batch of long rows
BATCH_BYTES = 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends at most about ``BATCH_BYTES`` to Python at once.  The bound is in bytes,
    so batches of short rows are what they were."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key, None)
    if not now or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as bigint and the text as string, under fixed names, whatever else the table holds."""
    return small_batches(docs).select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _filtered(batches, judge: Callable, column: str, id_at: int, text_at: int):
    held: list = []  # the batch that is being judged

    def plain():
        for b in batches:
            if b.num_rows:
                held.append(b)
                yield pa.RecordBatch.from_arrays([b.column(id_at).cast(pa.int64()), b.column(text_at).cast(pa.string()), pa.nulls(b.num_rows, pa.int64())], ["doc_id", "text", "text_key"])

    bad: list = []
    for out in judge(plain()):  # slices of a batch, in order
        bad += out.column(column).to_pylist()
        if len(bad) == held[0].num_rows:
            yield held.pop(0).filter(pa.array([not x for x in bad], pa.bool_()))
            bad = []


def filtered_in_place(docs: DataFrame, judge: Callable, column: str) -> DataFrame:
    """The rows of ``docs`` for which ``judge``, a generator over (doc_id, text) batches, gives false or 0 in ``column``;
    in place and with all their columns, whatever these are called."""
    names = docs.columns
    plain = small_batches(docs).toDF(*(f"c{i}" for i in range(len(names))))
    return plain.mapInArrow(partial(_filtered, judge=judge, column=column, id_at=names.index("doc_id"), text_at=names.index("text")), plain.schema).toDF(*names)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def apart(df: DataFrame) -> DataFrame:
    """Dealt by all columns: a join has to deal it by its key again, and AQE can split a hot key there."""
    return df.repartition(*df.columns)
