"""What the document operators share: input frames, bounded slices of Arrow batches, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

SLICE_BYTES = 2 << 20
#: Narrow rows that a file of a scratch table holds.
FILE_ROWS = 1 << 18


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_null: bool = False) -> DataFrame:
    """Columns `doc_id, text` only, so other columns of any name can't clash; a null text is empty unless `keep_null`."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (text if keep_null else F.coalesce(text, F.lit(""))).alias("text"))


def apart(docs: DataFrame, used: tuple[str, ...]) -> DataFrame:
    """`docs` with all columns but the `used` ones named by their place, so that no name can clash with a helper's.

    Give the result of an operator that keeps the columns its names back with `toDF(*docs.columns)`.
    """
    return docs.toDF(*[c if c in used else f"c{i}" for i, c in enumerate(docs.columns)])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_dir(spark)}/rangeloom/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_few(df: DataFrame, name: str, rows: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """The same for a table of at most `rows` rows: in as many files as those ask for, not one from every shuffle partition.

    For light last steps only, whose rows are that few; the steps before them keep their tasks.
    """
    return stored(df.coalesce(-(-rows // file_rows) or 1), name, "snappy")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            yield batch.slice(int(a), int(b - a))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of all elements of the runs (start, length), one run after the other."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total, dtype=np.int64)


def release() -> None:
    """Give freed memory of a Python worker back, since the worker lives on for tasks of other operators."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def fork_safe() -> None:
    """Keep the tokenizers library single-threaded inside a Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
