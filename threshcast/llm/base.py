"""What the operators share: written intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threshcast.session import fresh_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows and bytes of a batch that Spark hands to Python at once, where the session says nothing else.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> None:
    """Smaller Arrow batches for texts: several are held at once on both sides of a task."""
    spark = df.sparkSession
    for name, usual, value in (("maxRecordsPerBatch", 10_000, BATCH_ROWS), ("maxBytesPerBatch", 64 << 20, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, str(usual)).rstrip("bB") in (str(usual), str((1 << 31) - 1)):
            spark.conf.set(key, value)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder: short lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v) of type long.

    ``component`` is the smallest node reachable. Alternating large and small stars: every round
    points nodes at smaller ones until each points at the smallest. Rounds are written to the
    shared folder; two numbers a round reach the driver. Joins may be split by Spark where one
    node holds many edges; minima are combined before each shuffle. Loops and repeated edges are
    allowed; null ends are dropped.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = stored(edges.distinct(), "edges")
    seen = _digest(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = (
            large.join(small, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("u").alias("u"), F.col("m").alias("v")))))
            .select("col.u", "col.v")
        )
        after = stored(pairs.where("u <> v").distinct(), "edges")
        forget(now)
        now, before, seen = after, seen, _digest(after)
        if seen == before:
            break
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def keep_least(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of the smallest (id, text hash, hash of all columns) of each component; ``named`` has
    (th, component). Ties, missing ids and empty tables as in ``keep_one``."""
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    key = F.struct(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.xxhash64(*plain).alias("h")
    )
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(key.alias("k"), whole.alias("row"))
    known = rows.where("k.id is not null")
    least = known.select("k", F.col("k.th").alias("th")).join(named, "th").groupBy("component").agg(F.min("k").alias("k"))
    least = stored(least.select("k"), "kept")
    stay = known.join(least, "k", "left_semi").dropDuplicates(["k"]).select("row")
    stay = stay.union(rows.where("k.id is null").select("row"))
    return stay.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
