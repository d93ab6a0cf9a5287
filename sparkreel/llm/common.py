"""What the operators of this subpackage share: inputs, cut lineage, safe joins, connected components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times its row width stay under this.
BROADCAST_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset and driver and executors are one process, a temporary folder is made; on a cluster that would be another
    folder on each machine, so there it is an error.
    """
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors of {master!r} share")
        have = "file://" + tempfile.mkdtemp(prefix="sparkreel-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sparkreel/{what}-{uuid.uuid4().hex}"


_MADE: list[set[str]] = []
#: Bytes of text that go to Python at once.
BATCH_BYTES = 4 << 20


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    for made in _MADE:
        made.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_in_small_batches(df: DataFrame, what: str = "cut") -> DataFrame:
    """:func:`cut` of a frame whose rows pass through Python, at most BATCH_BYTES of them at a time; the session's own limit is set back.

    Spark sends up to 10,000 rows or 64 MB at once, and both the JVM and the worker hold some copies of them.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key, None)
    conf.set(key, str(BATCH_BYTES))
    try:
        return cut(df, what)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(*frames: DataFrame) -> None:
    """Delete the files under frames made by :func:`cut`, which nothing reads any more."""
    for df in frames:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            _delete(df.sparkSession, folder)


@contextlib.contextmanager
def leaving(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what :func:`cut` wrote inside it, but for the frame that goes through the function it gives,
    which cuts it unless it was cut already."""
    made: set[str] = set()
    left: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        out = df if getattr(df, "_cut_path", None) in made else cut(df, "kept")
        left.add(out._cut_path)
        return out

    _MADE.append(made)
    try:
        yield keep
    finally:
        _MADE.remove(made)
        for path in made - left:
            _delete(spark, path)


def clear_shared(spark: SparkSession) -> None:
    """Delete everything that :func:`cut` and the writers left in the shared folder; call it when no result is in use."""
    _delete(spark, f"{shared_dir(spark)}/sparkreel")


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its counted size is under ``limit``; unmarked otherwise (Spark then shuffles)."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of 64 bits that a filter has at most.
FILTER_WORDS = 1 << 20


def bit_filter(hashes: DataFrame) -> DataFrame:
    """A filter of the distinct longs ``h``: rows (word, bits) of 64 bits, 16 bits for each hash, and never more than FILTER_WORDS rows."""
    hashes = hashes.select("h").distinct()
    words = min(FILTER_WORDS, 1 << max(4, (hashes.count() // 4).bit_length()))
    own = F.pmod(F.shiftright("h", 6), F.lit(words)).cast("int")
    found = hashes.groupBy(own.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))
    return found.withColumn("words", F.lit(words))


def maybe_in(rows: DataFrame, bits: DataFrame, h: str) -> DataFrame:
    """``rows`` with ``maybe__``: false where the long ``h`` is certainly not in the filter.  The filter is broadcast."""
    words = bits.select("words").first()
    if words is None:
        return rows.withColumn("maybe__", F.lit(False))
    side = F.broadcast(bits.select(F.col("word").alias("word__"), F.col("bits").alias("bits__")))
    marked = rows.withColumn("word__", F.pmod(F.shiftright(h, 6), F.lit(words[0])).cast("int")).join(side, "word__", "left")
    hit = F.col("bits__").bitwiseAND(F.expr(f"shiftleft(1L, cast({h} & 63 as int))")) != 0
    return marked.withColumn("maybe__", F.coalesce(hit, F.lit(False))).drop("word__", "bits__")


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of least hash of ``key``.

    A first cut by hash leaves little more than ``rows`` of all rows, so tasks don't each send so many to be merged.
    """
    total = df.count()
    if total > 2 * rows:
        share = 1.5 * rows / total + 10 / total
        df = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40)))
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 40)), key).limit(rows)


def folds(modulus: int, key: str | Column = "doc_id") -> Column:
    """crc32 of the key as text, modulo ``modulus``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % modulus


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("long"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of undirected edges; the component is its smallest node.

    Alternating large and small stars over edge rows: every step is a minimum by node (summed before the shuffle)
    and an equi-join that Spark may split where a node has very many edges.  Nulls and self-loops are ignored,
    repeated edges count once; no edges give no rows.  A node without an edge has no row.
    """
    x, y = F.col(a), F.col(b)
    now = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    now = cut(now, "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        pairs = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(pairs.where(F.col("u") != F.col("v")).distinct(), "edges")
        new = _mark(after)
        remove(now)
        now = after
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
