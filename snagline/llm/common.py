"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: A-Z become a-z, every other byte stays.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Words of letters, digits and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; sorting is many times faster than numpy's hashing unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def text_of(column: str | Column) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A folder of its own is made only where the session names none and driver
    and executors are one process (tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="snagline-checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a broadcast side, counted before the join.
BROADCAST_BYTES = 16 << 20


def _width(column: Column, kind: T.DataType) -> Column:
    """About the bytes of a value; text and binary as they are, an array by its elements."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = F.aggregate(column, F.lit(0), lambda a, x: (a + _width(x, kind.elementType)).cast("int"))
        return F.coalesce(inner, F.lit(0)) + 16
    return F.lit(16)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast when the counted bytes of the rows stay below the bound.

    Rows are counted up to what the bound could hold, then their bytes.  Beyond
    it the join shuffles both sides; the rows that come out are the same.
    """
    most = max_bytes // (16 * max(1, len(df.columns)))
    widths = [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    size = df.limit(most + 1).select(sum(widths, F.lit(0)).alias("w")).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if size[0] <= most and size[1] <= max_bytes else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))



#: Bytes of texts that a task turns into Python strings at a time.
SLICE_BYTES = 1 << 20


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES, one row at least."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, max(1, batch.num_rows), step):
            yield batch.slice(at, step)


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, some at a time."""
    for part in slices([pa.RecordBatch.from_arrays([column], ["text"])]):
        yield from part.column(0).to_pylist()


def add_text_columns(df: DataFrame, text: str, keep: list[str], fields: str, maker: Callable[[], Callable]) -> DataFrame:
    """The columns in keep, then those that a function makes of each whole text.

    fields is a schema string.  maker is called once a task and gives a
    function from the text (str, null as empty) to one tuple per row.  Arrow
    batches go through in slices of about SLICE_BYTES; no row is held longer.
    """
    added = T.StructType.fromDDL(fields)
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))
    out = T.StructType([*kept.schema.fields[:-1], *added.fields])
    types = [to_arrow_type(f.dataType) for f in added.fields]
    names = [f.name for f in out.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            made = list(zip(*[make(t or "") for t in texts])) or [[] for _ in types]
            columns = [*batch.columns[:-1], *[pa.array(c, t) for c, t in zip(made, types)]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return kept.mapInArrow(run, out)
