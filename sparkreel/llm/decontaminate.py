"""Benchmark decontamination by spaced-seed hashing.

A mask fixes which token positions of a window count.  The counted tokens of every window of the benchmark and of the
training texts are hashed and joined, so a window with other tokens at ignored positions still hits.  Each hit
gives a diagonal of (document, item); along it the two texts are compared token by token, and an overlap counts if some
WINDOW aligned tokens differ in at most ERRORS places (all of an item of LEAST to WINDOW - 1 tokens, without errors; items
of fewer tokens are no evidence).  The masks together hit every such overlap: see
:func:`covers`.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bit_filter, cut, maybe_in, small

WINDOW, ERRORS, LEAST = 13, 2, 8
#: Positions that count; every overlap of WINDOW tokens with ERRORS substitutions has one of these, somewhere, intact.
MASKS = ((0, 1, 2, 4, 7, 9), (0, 1, 2, 4, 5, 6))


def covers(masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, errors: int = ERRORS) -> bool:
    """Whether the masks hit every placement of the substitutions in a window."""
    spans = [{o + p for p in m} for m in masks for o in range(window - max(m))]
    return all(any(not s & set(e) for s in spans) for e in combinations(range(window), errors))


def tokens(text: str | Column) -> Column:
    """Hashes of the words: runs of letters and digits after lower-casing; null and empty texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keys: list[str], masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(keys, pos, h): for each window start and mask that fits, the hash of the counted tokens."""
    shortest = min(max(m) for m in masks) + 1
    at = rows.where(F.size("tok") >= shortest).select(*keys, "tok", F.explode(F.sequence(F.lit(0), F.size("tok") - shortest)).alias("pos"))
    word = [F.get("tok", F.col("pos") + i) for i in range(max(map(max, masks)) + 1)]
    hashes = [F.when(F.col("pos") + max(m) < F.size("tok"), F.xxhash64(F.lit(k), *(word[i] for i in m))) for k, m in enumerate(masks)]
    return at.select(*keys, "pos", F.explode(F.array(*hashes)).alias("h")).where("h is not null")


def _matches(seeds: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """``seeds`` joined with ``wanted`` on h, without a shuffle of all seeds.

    Up to ``limit`` bytes, counted, the benchmark's seeds are broadcast.  More of them become a filter of bits first, which is
    broadcast and has a fixed bound; only seeds whose bit is set are shuffled and joined.
    """
    most = limit // 40
    if wanted.limit(most + 1).count() <= most:
        return seeds.join(F.broadcast(wanted), "h")
    wanted = cut(wanted, "seeds")
    likely = maybe_in(seeds, cut(bit_filter(wanted), "filter"), "h").where("maybe__").drop("maybe__")
    return likely.join(wanted, "h")


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, windows, matched, doc_pos, item_pos of every document that overlaps an item; no others.

    ``windows``: aligned windows that count; ``matched``: most equal tokens in one; ``doc_pos`` and ``item_pos``: where the first
    such window starts.  Null, empty and short texts and null ids match nothing.  Rows that repeat a doc_id are one
    document, which overlaps if any of them does; the same holds for item_id.  More columns are ignored.  The benchmark's hashes
    are broadcast if they are counted under ``broadcast_bytes``; beyond, a filter of them is (:func:`_matches`).
    """
    items = benchmark.where("item_id is not null").select("item_id", tokens("text").alias("tok")).where(F.size("tok") >= LEAST)
    wanted = _seeds(items, ["item_id"], MASKS).select("item_id", F.col("pos").alias("item_at"), "h").distinct()
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    seeds = _seeds(texts.select("doc_id", tokens("text").alias("tok")), ["doc_id"], MASKS)
    hits = _matches(seeds, wanted, broadcast_bytes).select("doc_id", "item_id", (F.col("pos") - F.col("item_at")).alias("diagonal")).distinct()
    hits = cut(hits, "hits")
    hit_ids = small(hits.select("doc_id").distinct(), 24)
    again = texts.join(hit_ids, "doc_id", "left_semi").select("doc_id", tokens("text").alias("tok"))
    pairs = again.join(hits, "doc_id").join(items.select("item_id", F.col("tok").alias("item")), "item_id")
    width = F.least(F.size("item"), F.lit(WINDOW))
    same = F.transform(F.sequence(F.lit(0), F.size("item") - 1), lambda i: F.coalesce(F.when(F.col("diagonal") + i >= 0, F.get("tok", F.col("diagonal") + i)) == F.get("item", i), F.lit(False)).cast("int"))
    pairs = pairs.withColumn("same", same).withColumn("width", width).withColumn("least", F.when(width < WINDOW, width).otherwise(WINDOW - ERRORS))
    sums = F.transform(F.sequence(F.lit(1), F.size("item") - F.col("width") + 1), lambda i: F.struct(i.alias("at"), F.aggregate(F.slice("same", i, F.col("width")), F.lit(0), lambda a, x: a + x).alias("m")))
    inside = F.filter(sums, lambda w: (w["m"] >= F.col("least")) & (F.col("diagonal") + w["at"] > 0) & (F.col("diagonal") + w["at"] + F.col("width") - 1 <= F.size("tok")))
    pairs = pairs.select("doc_id", "item_id", "diagonal", F.explode(inside).alias("w"))
    return pairs.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("windows"),
        F.max("w.m").alias("matched"),
        F.min((F.col("diagonal") + F.col("w.at") - 1)).alias("doc_pos"),
        F.min(F.col("w.at") - 1).alias("item_pos"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap an item; rows with a null doc_id stay."""
    leaks = small(cut(contamination(docs, benchmark).select("doc_id").distinct(), "leaks"), 24)
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


#: Without seeds: 13 tokens with 2 substitutions hold 4 equal ones in a row (an exact short item does so too), so aligned runs of 4
#: are all the candidates there are.
SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') t from documents where text is not null and doc_id is not null),
b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') t from benchmark where item_id is not null),
i as (select *, least(len(t), 13) w, case when len(t) < 13 then len(t) else 11 end need from b where len(t) >= 8),
dg as (select doc_id, p, t[p] || ' ' || t[p + 1] || ' ' || t[p + 2] || ' ' || t[p + 3] g from (select doc_id, t, unnest(range(1, len(t) - 2)) p from d)),
ig as (select item_id, p, t[p] || ' ' || t[p + 1] || ' ' || t[p + 2] || ' ' || t[p + 3] g from (select item_id, t, unnest(range(1, len(t) - 2)) p from i)),
g as (select distinct doc_id, item_id, dg.p - ig.p diagonal from dg join ig using (g)),
x as (select doc_id, item_id, diagonal, w, need, d.t dt, [case when diagonal + k >= 1 and d.t[(diagonal + k)::int] = i.t[k] then 1 else 0 end for k in range(1, len(i.t) + 1)] same, i.t it from g join d using (doc_id) join i using (item_id)),
y as (select doc_id, item_id, diagonal, need, w, len(dt) n, a, list_sum(same[a:a + w - 1]) m from (select *, unnest(range(1, len(it) - w + 2)) a from x))
select doc_id, item_id, count(*) windows, max(m)::int matched, min(diagonal + a - 1)::int doc_pos, min(a - 1)::int item_pos
from y where m >= need and diagonal + a > 0 and diagonal + a + w - 1 <= n group by 1, 2
"""
