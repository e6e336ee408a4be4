"""Where intermediate results go, and when a side is small enough to broadcast."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A broadcast side is counted first and sent only when it has at most this many rows and, where
#: it holds texts or arrays, at most this many bytes of them.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else one below the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured is None and current is not None:
        return current
    if configured is None:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if current is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: short lineage, partitioning kept, survives a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_SET: dict[str, tuple[int, str | None]] = {}
_SET_LOCK = Lock()


@contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Session settings (underscores for dots) for the time of a block.

    Blocks of several threads may overlap: what was set before the first comes back after the last.
    """
    names = {k: k.replace("_", ".") for k in values}
    with _SET_LOCK:
        for k, n in names.items():
            blocks, before = _SET.get(n, (0, spark.conf.get(n, None)))
            _SET[n] = (blocks + 1, before)
            spark.conf.set(n, str(values[k]))
    try:
        yield
    finally:
        with _SET_LOCK:
            for n in names.values():
                blocks, before = _SET.pop(n)
                if blocks > 1:
                    _SET[n] = (blocks - 1, before)
                elif before is None:
                    spark.conf.unset(n)
                else:
                    spark.conf.set(n, before)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def observed(df: DataFrame, label: str, *sums: Column) -> tuple[DataFrame, tuple]:
    """``df`` written once and read again, and the aggregates ``sums`` of it, in one job."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    seen = Observation()
    named = [c.alias(f"s{i}") for i, c in enumerate(sums)]
    (df.observe(seen, *named) if named else df).write.parquet(path)
    found = tuple(seen.get[f"s{i}"] for i in range(len(named))) if named else ()
    return spark.read.schema(df.schema).parquet(path), found


def discard(df: DataFrame) -> None:
    """Delete the files of a table ``observed`` wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows, and its texts and arrays at most
    ``BROADCAST_BYTES``; counted in every task, so one row a task is exchanged."""
    wide = [
        F.length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
        for f in df.schema
        if f.dataType.typeName() in ("array", "map", "struct", "binary")
    ]
    wide += [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema if f.dataType.typeName() == "string"]
    size = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(0)).cast("long")
    n, total = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return n <= rows and (total or 0) <= BROADCAST_BYTES


def broadcast_if_small(
    df: DataFrame, rows: int = BROADCAST_ROWS, derived: bool = False
) -> DataFrame:
    """Broadcast hint behind a count of rows and bytes; a larger side is left to a shuffled join.

    A side ``derived`` from large data is checkpointed first, so that counting it and joining
    it do not compute it twice.
    """
    df = cut(df) if derived else df
    return F.broadcast(df) if fits(df, rows) else df
