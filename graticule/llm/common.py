"""Helpers that the corpus operators share: scratch tables, hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of ASCII letters and digits and of every character beyond ASCII.
ALNUM_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset an own one, if all run on this machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graticule-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint; with spark.cleaner.referenceTracking.cleanCheckpoints its files go when the driver drops the frame."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes of a row group of scratch tables, which writers and readers hold in memory.
ROW_GROUP = 16 << 20


#: Scratch tables that this process has written and not yet cleared.
_WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back; the table stays until `clear`."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> set[str]:
    """The scratch tables that there are."""
    return set(_WRITTEN)


def clear(spark: SparkSession, but: DataFrame | None = None, before: set[str] = frozenset()) -> int:
    """Delete this process's scratch tables, except those in `before` and the one that `but` reads; how many went.  Only for frames that are no longer read."""
    keep = [p for p in _WRITTEN if p in before or (but is not None and any(p.rsplit("/", 1)[-1] in f for f in but.inputFiles()))]
    gone = [p for p in _WRITTEN if p not in keep]
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN[:] = keep
    return len(gone)


def crc_rest(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))


def space_words(raw: bytes) -> list[bytes]:
    """Runs of bytes other than ASCII white space (0x20, 0x09-0x0D), which is what bytes.split() cuts at."""
    return raw.split()


def utf8(value) -> bytes:
    """A text's UTF-8 bytes; null is empty."""
    if value is None:
        return b""
    return value if isinstance(value, bytes) else value.encode("utf-8", "surrogatepass")


def small_slices(batch, most_bytes: int = 4 << 20, column: str = "text"):
    """Cut a record batch so that each slice holds about `most_bytes` of text, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


#: Edges that one task contracts.
CONTRACT = 400_000


def _contracted(e: DataFrame, n: int) -> DataFrame:
    """Edges (hi, lo), of longs, with those of some partitions together replaced by stars around the least node of what they connect."""

    def run(batches):
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if rows:
            hi, lo = (np.concatenate(x) for x in zip(*rows))
            ids, place = np.unique(np.concatenate((hi, lo)), return_inverse=True)
            forest = Forest(len(ids))
            for x, y in zip(place[: len(hi)].tolist(), place[len(hi) :].tolist()):
                forest.join(x, y)
            root = np.array([forest.find(k) for k in range(len(ids))])
            on = root != np.arange(len(ids))
            yield pa.RecordBatch.from_pydict({"hi": ids[on], "lo": ids[root[on]]})

    return e.coalesce(max(1, -(-n // CONTRACT))).mapInArrow(run, "hi long, lo long").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, contract: bool = False) -> DataFrame:
    """Components by alternating large and small stars; native DataFrame operations only, unless `contract` joins what partitions hold first.

    Returns (node, component), one row for each node of an edge between two different
    nodes; component is the smallest node reachable.  Null ends and loops are ignored.
    Each round is checkpointed, so that a lost executor costs one round at most.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("hi <> lo").distinct()

    def state(e: DataFrame):
        h = F.xxhash64("hi", "lo")
        return e.agg(F.count("*"), F.sum(h.bitwiseAND((1 << 31) - 1)), F.sum(F.shiftrightunsigned(h, 33))).first()

    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = checkpointed(tidy(e.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))))
    last = state(e)
    if contract and last[0]:
        e = checkpointed(_contracted(e, last[0]))
        last = state(e)
    for _ in range(rounds if last[0] else 0):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = checkpointed(tidy(small.unionByName(least.select("hi", F.col("m").alias("lo")))))
        now = state(e)
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def labelled_sample(docs: DataFrame, ids: DataFrame, classes: list, most: int) -> list[tuple[str, object]]:
    """(text, label) of at most `most` documents of each class, those whose ids hash lowest; ids: (doc_id, label).

    Ids are picked first, and only the sample's texts move.  Of rows with one id the least text counts.
    """
    ids = ids.select("doc_id", "label").distinct().join(docs.select("doc_id"), "doc_id", "left_semi")
    some = None
    for c in classes:
        own = ids.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = own if some is None else some.unionByName(own)
    if some is None:
        return []
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return [(r[0] or "", r[1]) for r in rows.orderBy("label", "doc_id").select("text", "label").collect()]


def give_back(collect: bool = True) -> None:
    """Return memory that a fit has freed to the system, where the C library can; workers and the driver run beside their JVMs."""
    if collect:
        gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def settle(spark: SparkSession) -> None:
    """Between large steps: the driver's JVM collects its garbage, so that Spark drops shuffles, broadcasts and checkpoints that no frame reads any more, and what it has freed goes back to the system, where the JVM can."""
    give_back()
    jvm = spark._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):  # JVMs without this command keep their free native memory
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = commands, "systemTrimNativeHeap"
        # the server's own class is closed to py4j, its interface is not
        methods = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
        next(m for m in methods if m.getName() == "invoke").invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


class Forest:
    """Union-find over the integers below n, kept in one numpy array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y
