"""What the corpus operators share: staged tables, Arrow helpers, word hashes, link groups."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, one temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidemark-"))
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Writes a table to the shared folder and reads it again: the lineage ends there, and lost executors cost no rerun of it.

    Staged tables of `instead_of`, which nothing may read any more, are removed when the new one is whole.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    for old in instead_of:
        where = spark._jvm.org.apache.hadoop.fs.Path(old.staged_at).getParent()
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return out


#: Bytes of a batch that goes to Python, where the session names no number of its own.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Cuts batches for Python by bytes as well as by rows: a task holds several copies of one, most of them outside the heap, and texts may be long."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def strings(column: pa.Array) -> list:
    """Python strings (or None) of an Arrow column."""
    return column.to_pylist()


def long_matrix(column: pa.Array, width: int) -> np.ndarray:
    """rows x width int64 out of an Arrow list<int64> column without nulls."""
    flat = column.flatten() if hasattr(column, "flatten") else column
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), width)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes of the links with the smallest node that each can reach: columns node, component (long).

    Each round every node takes its first neighbour as parent, parents are followed twice
    more (four links up), and links become links between those. First is the smallest in
    even rounds, which ends a star at once, and the first by a fresh hash in odd ones: then a
    node with a neighbour keeps its place with a probability of one half at most, so the
    nodes that are left halve whatever order the ids have, and a chain of n takes about
    2 log n rounds. All of it stays in tables: the driver sees one row a round. Nulls take no
    part; repeated links and self links do no harm; no links give no rows.
    """
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    labels = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    turn = 0
    open_pairs = pairs.where("a < b")
    while open_pairs.take(1):
        both = open_pairs.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))
        if turn % 2:
            up = _first_by_hash(both, turn)
        else:
            up = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("parent"))
        up = staged(up, "up")
        for _ in range(2):
            over = up.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            up = staged(up.join(over, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent")), "up", (up,))
        ua, ub = (up.select(F.col("node").alias(x), F.col("parent").alias("p" + x)) for x in "ab")
        moved = open_pairs.join(ua, "a").join(ub, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        pairs = staged(moved.where("a < b").distinct(), "pairs", (pairs,))
        ul = up.select(F.col("node").alias("root"), "parent")
        labels = staged(labels.join(ul, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "labels", (labels, up))
        open_pairs, turn = pairs, turn + 1
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return staged(labels.join(least, "root").select("node", "component"), "components", (pairs, labels))


def _first_by_hash(both: DataFrame, turn: int) -> DataFrame:
    """node, parent: of a node and its neighbours the one with the smallest hash."""
    mixed = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))
    return both.groupBy("node").agg(F.min(mixed("other")).alias("low")).select("node", F.least(F.col("low"), mixed("node"))["id"].alias("parent"))
