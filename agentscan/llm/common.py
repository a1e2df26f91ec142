"""Reading tables, the shared work folder, written intermediate tables and batch-wise text maps.

Everything an operator keeps between two jobs is written as Parquet under the folder that the
session names in ``spark.checkpoint.dir``, so a lost executor costs a read and not a result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Temporary folders of sessions on this machine alone, by application.
_OWN: dict[str, str] = {}
#: Rows of one Arrow batch; texts are long, so far fewer than Spark's 10,000.
BATCH_ROWS = 1024
#: Bytes of text that one call of a batch function gets, unless one text alone is longer.
CHUNK_BYTES = 3_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches of text that Python workers hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared one.

    Where none is set, a session on this machine alone gets a temporary folder of its own; on a
    cluster, whose executors write to other disks, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _OWN[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage, pruned columns."""
    path = work_dir(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    for df in dfs:
        if path := getattr(df, "_written_to", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the offsets of its rows; null is empty."""
    a = column.cast(pa.string()) if column.type != pa.string() else column
    if a.null_count:
        a = a.fill_null("")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text each; a longer text stands alone."""
    _, off = utf8(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def map_text(
    df: DataFrame,
    column: str,
    added: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    keep: list[str] | None = None,
    most: int = CHUNK_BYTES,
) -> DataFrame:
    """``df``'s columns ``keep`` (all, if None) and the columns that a batch function adds.

    ``make`` runs once a task and returns the function, which gets part of a batch, with the text as
    ``__text__``, and returns one array for each field of ``added``. An added name that ``df`` has already replaces it.
    """
    names = {f.name for f in added}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    inner = column if column in keep else "__text__"
    src = df.select(*[F.col(f"`{c}`") for c in keep], *([] if inner in keep else [F.col(f"`{column}`").alias(inner)]))
    schema = T.StructType([src.schema[c] for c in keep] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, inner, most):
                kept = [part.column(c) for c in keep]
                seen = pa.RecordBatch.from_arrays([*kept, part.column(inner)], names=[*keep, "__text__"])
                yield pa.RecordBatch.from_arrays(kept + work(seen), names=keep + added.fieldNames())

    return src.mapInArrow(run, schema)
