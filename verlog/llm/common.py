"""What the operators share: reading tables, written cuts of the lineage, broadcasts, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast of more bytes than this is refused; the callers have another way then.
MAX_BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode (tests), and an
    error on a cluster, whose executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="verlog-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_root(spark)}/verlog/{tag}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later work survives lost executors and nothing runs twice."""
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written cut that no returned plan reads any more."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_cut(spark: SparkSession, df: DataFrame) -> None:
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Fewer rows at once to Python workers, where the session has the default: a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


_KEPT: dict = {}


def kept(owner: str, key: object, make: Callable):
    """What a Python worker keeps from task to task (known words, say): of the last operator only, so that what a
    pipeline's stages keep does not add up."""
    if _KEPT.get("of") != (owner, key):
        _KEPT.clear()
        give_back()
        _KEPT.update(of=(owner, key), value=make())
    return _KEPT["value"]


def give_back() -> None:
    """Freed memory of a Python worker to the system: a hint, without effect on results."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another libc


def tidy(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A function for ``mapInArrow`` that gives freed memory back when its task is done."""

    @wraps(run)
    def tidied(batches: Iterable) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def small(df: DataFrame, row_bytes: int, bound: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` (a written cut, so this is a footer count) is within ``bound``."""
    return df.count() * row_bytes <= bound


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected edge list: (node, component), the component being the smallest node in it.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): a hub's neighbours hang on its minimum, so a
    group of copies turns into a star in a few rounds. Each round is two grouped minima and joins over edges that are
    written to the shared folder; nothing but a change count comes to the driver. Nodes without edges do not appear.
    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    cur = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    cur = cut(spark, cur.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        nxt = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        nxt = cut(spark, nxt.where("u <> v").distinct(), "edges")
        # done when it is a star forest: every u once, and no v is a u
        nodes = nxt.select(F.col("u").alias("x"), F.lit(1).alias("u"), F.lit(0).alias("v")).unionByName(nxt.select(F.col("v").alias("x"), F.lit(0).alias("u"), F.lit(1).alias("v")))
        state = nodes.groupBy("x").agg(F.sum("u").alias("u"), F.max("v").alias("v")).agg(F.max("u").alias("u"), F.max(F.expr("u > 0 and v > 0")).alias("both")).first()
        drop_cut(spark, cur)
        if state["u"] is None or state["u"] == 1 and not state["both"]:
            break
        cur = nxt
    return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(nxt.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are done: a hint, without effect on results."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
