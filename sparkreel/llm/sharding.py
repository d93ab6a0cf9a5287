"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; a row's fractional rank is (2r + 1) / (2n) for its rank r among the n
of its source.  All rows in the order of the fractional rank are an even blend, so contiguous cuts of that order are shards
that each match the whole mixture.

Rows that agree in all that is returned are interchangeable: they are counted before anything else and dealt out again by number, so the
shuffle is by row, not by id, and neither a hot id, a hot source nor many copies meet in one task.  Both ranks are counted in two
steps: a row's bin (by hash within its source; by fractional rank over all) has few rows, is ranked alone, and the bins before it
add their counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that a bin should hold at least; beyond its square, bins and their sizes both grow with the square root of the rows.
BIN_ROWS = 4096
#: Copies that one task deals out.
COPIES = 1 << 16


def _numbered(rows: DataFrame) -> DataFrame:
    """Each distinct row once for each of its copies, with ``copy`` from 0."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    few = counted.where(F.col("n") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = counted.where(F.col("n") > COPIES).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition(*rows.columns, "from").withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, "n") - 1)))
    return few.drop("n").unionByName(many.drop("n", "from"))


def interleave(docs: DataFrame, shards: int, seed: str = "0", strata: str = "source", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``rows``: shard sizes differ by one row at most, and each source's share of a shard by about a row.
    A null text has size 8 and crc32 0; null sources are one stratum; rows that agree in key, source, size and crc32 are interchangeable.
    More columns are ignored, but for ``row``, a unique number of each row, which is returned too.  Fewer rows than shards leave shards
    empty; no rows give no rows.
    """
    total = docs.count()
    bins = max(16, int(total // max(BIN_ROWS, total**0.5)))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    named = [] if row is None else [F.col(row).alias("row")]
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(strata).cast("string"), F.lit("\x00")).alias("stratum"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *named,
    )
    rows = _numbered(rows) if row is None else rows.withColumn("copy", F.col("row"))
    own = ["doc_id", "size", "text_crc32", "copy"]
    rows = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in own)).cast("binary")))
    rows = rows.withColumn("bin", F.floor(F.conv(F.substring("h", 1, 7), 16, 10).cast("long") * bins / (1 << 28)).cast("int"))
    counts = rows.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("stratum").orderBy("bin")
    offsets = counts.select("stratum", "bin", (F.sum("n").over(before) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("of"))
    order = Window.partitionBy("stratum", "bin").orderBy("h", *own)
    ranked = rows.join(offsets, ["stratum", "bin"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    ranked = ranked.withColumn("at", (2 * F.col("rank") + 1) / (2 * F.col("of")))
    ranked = ranked.withColumn("part", F.floor(F.col("at") * bins).cast("int")).drop("h", "bin", "before", "of")
    # as many rows as bins, at most the square root of the rows
    sizes = ranked.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    inner = Window.partitionBy("part").orderBy("at", "stratum", "rank")
    placed = ranked.join(starts, "part").withColumn("pos", F.col("start") + F.row_number().over(inner) - 1)
    placed = placed.withColumn("shard", F.expr(f"cast(pos * {shards} div {max(total, 1)} as int)"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"pos - (shard * cast({total} as bigint) + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *([] if row is None else ["row"]),
    )


def write_shards(docs: DataFrame, shards: int, path: str, seed: str = "0", strata: str = "source", key: str = "doc_id") -> str:
    """Write every row of ``docs``, with all its columns, in one folder for each shard, in slot order within a file; the folders' column.

    Rows are numbered and written to the shared folder first, so null and repeated keys are placed like all others.  The folders are
    named by ``shard``, with underscores behind it if ``docs`` has such a column.  No rows: no folders.
    """
    unused = lambda name: name if name not in docs.columns else unused(name + "_")
    row, shard, slot = (unused(x) for x in ("row", "shard", "slot"))
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    placed = interleave(numbered, shards, seed, strata, key, row).select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    rows = numbered.join(placed, row).repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
    rows.select(*docs.columns, shard).write.partitionBy(shard).parquet(path)
    return shard


#: crc32 is folded byte by byte, as the other engine has no such function.
SQL = """
with tab as (
  select list(v order by i) t from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) v from (select unnest(range(256)) i))),
r as (
  select doc_id, coalesce(source, chr(0)) stratum, octet_length(encode(coalesce(text, ''))) + 8 size, hex(encode(coalesce(text, ''))) x from documents),
c as (
  select r.*, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint)) crc from r, tab),
m as (select *, row_number() over (partition by doc_id, stratum, size, crc) - 1 cp from c),
h as (select *, md5(concat_ws(':', '0', doc_id::varchar, size::varchar, crc::varchar, cp::varchar)) h from m),
k as (select *, row_number() over (partition by stratum order by h, doc_id, size, crc, cp) - 1 rk, count(*) over (partition by stratum) n from h),
p as (select *, row_number() over (order by (2 * rk + 1)::double / (2 * n)::double, stratum, rk) - 1 pos, count(*) over () total from k)
select doc_id, size::bigint size, crc::bigint text_crc32, 'rows' law, (pos * 24 // total)::int shard, (pos - (pos * 24 // total * total + 23) // 24)::bigint slot, null::int grown_shard from p
"""
