"""What several operators share: shared-storage tables, checked joins, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}

#: Rows and bytes that a broadcast side may have at most.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 8 << 20
#: Rows of one key from which on a shuffled join deals them over several tasks.
HOT_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one
    on a local master; on a cluster, whose machines share no such folder, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="spark-meterscope-")
    return _OWN_DIRS[app]


#: Rows and bytes of a batch that goes to a Python worker: a batch of long texts is held four times over, in the
#: executor's buffers and the worker's.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """BATCHES as the session's setting for the jobs run within, then what was set before."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meterscope-{uuid.uuid4().hex}/{name}"
    with small_batches(spark):
        df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders written within the settled() calls that run now, innermost last.
_SCOPES: list[list[str]] = []


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make() in shared storage, without the tables that it has stored on the way: those are removed once it is
    written. For steps of which nothing but the result is read later."""
    _SCOPES.append([])
    try:
        out = materialize(make(), name)
    finally:
        paths = _SCOPES.pop()
        if _SCOPES:
            _SCOPES[-1] += paths  # removed with the outer step's, if not here
    context = out.sparkSession.sparkContext
    for path in paths[:-1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    if _SCOPES:
        _SCOPES[-1][-len(paths) :] = paths[-1:]
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(docs: DataFrame, read: tuple[str, ...], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f(docs) while all columns but `read` have neutral names, so that none can clash with f's own."""
    named = docs.columns
    hidden = [c if c in read else f"__column{i}" for i, c in enumerate(named)]
    return f(docs.toDF(*hidden)).select(*hidden).toDF(*named)


def fits(small: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether small has no more rows and bytes than a broadcast side may have. It is counted: materialise it first."""
    wide = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in small.schema if f.dataType.simpleString() in ("string", "binary")]
    bytes_ = sum(wide, F.lit(16 * len(small.columns))).cast("long")
    got = small.select(bytes_.alias("b")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return got["n"] <= rows and (got["b"] or 0) <= size


def join_checked(big: DataFrame, small: DataFrame, on: str, how: str = "inner", limit: int = BROADCAST_ROWS, salts: int = 32, hot: int = HOT_ROWS) -> DataFrame:
    """Join big with small (at most one row per key) on one column. small is broadcast if its rows and bytes
    have been counted to be few. Beyond that the join is shuffled; keys that more than `hot` rows of big
    have are dealt over `salts` tasks, and only their rows of small are copied."""
    if fits(small, limit):
        return big.join(F.broadcast(small), on, how)
    marks = materialize(big.groupBy(on).count().where((F.col("count") > hot) & F.col(on).isNotNull()).select(on, F.lit(True).alias("__hot")), "hot-keys")
    marks = F.broadcast(marks) if fits(marks) else marks  # at most a row for `hot` rows of big
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    left = big.join(marks, on, "left").withColumn("__salt", F.when(F.col("__hot") | F.col(on).isNull(), dealt).otherwise(F.lit(0))).drop("__hot")
    all_ = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(marks, on, "left").withColumn("__salt", F.explode(all_)).drop("__hot")
    return left.join(right, [on, "__salt"], how).drop("__salt")


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u long, v long); component is the least node. In shared storage."""
    return settled(lambda: _components(edges, name, max_rounds), f"{name}-labels")


def _components(edges: DataFrame, name: str, max_rounds: int) -> DataFrame:
    """(node, component) for every node of edges (u long, v long); component is the least node.

    Contraction: every node hooks to its least neighbour, pointers are doubled until they are at roots,
    and edges are mapped to the roots; edges inside a component vanish, so a round works on what is left,
    at most half the nodes. Every round is written to shared storage; the driver only sees whether
    there is an edge or a moved pointer left.
    """
    edges = edges.where("u != v").select("u", "v").distinct()
    both = materialize(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = None
    for step in range(max_rounds):
        if both.isEmpty():
            break
        parent = both.groupBy("u").agg(F.least("u", F.min("v")).alias("p"))
        parent = materialize(parent, f"{name}-p{step}")
        for jump in range(64):  # pointers double until all are at roots, so a long path takes few rounds
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("p1"))
            upper = parent.select(F.col("u").alias("p1"), F.col("p").alias("p2"))
            jumped = join_checked(parent, up, "p", "left").withColumn("p1", F.coalesce("p1", "p"))
            jumped = join_checked(jumped, upper, "p1", "left").withColumn("p2", F.coalesce("p2", "p1"))
            jumped = materialize(jumped.select("u", F.col("p2").alias("p"), (F.col("p2") != F.col("p1")).alias("moved")), f"{name}-q{step}-{jump}")
            parent = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            up = parent.select(F.col("u").alias("component"), F.col("p").alias("pp"))
            labels = join_checked(labels, up, "component", "left").select("node", F.coalesce("pp", "component").alias("component"))
        labels = materialize(labels, f"{name}-l{step}")
        mapped = join_checked(both, parent, "u").select(F.col("p").alias("a"), F.col("v").alias("u"))
        mapped = join_checked(mapped, parent, "u").select(F.col("a").alias("u"), F.col("p").alias("v"))
        both = materialize(mapped.where("u != v").distinct(), f"{name}-e{step}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return both.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    return labels
