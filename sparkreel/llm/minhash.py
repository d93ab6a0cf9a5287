"""MinHash near-duplicates by a multi-index Hamming join.

Every text becomes a set of word shingles and a signature of ``CHUNKS * ROWS`` minima, of which ``BITS`` bits each
are kept.  By pigeonhole, two signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` minima share a chunk with
at most ``ERRORS`` differing minima; the chunk is indexed once for every choice of positions that may differ, so each
such pair meets in a bucket.  Pairs of similarity 0.8 miss every bucket with a probability of 2e-6.

No bucket's pairs are all emitted.  First each member is compared with the bucket's least member.  What these links
join is then one component, and only pairs of *different* components that share a bucket are looked at, inside
tasks of bounded size, against an exact bound: the odd sketch of a set flips one bit for each member, so the bits in which
two sketches differ are a lower bound of the symmetric difference.  Pairs that the bound can't rule out are confirmed
on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import connected_components, cut, cut_in_small_batches, remove, small

CHUNKS, ROWS, ERRORS, BITS = 10, 5, 1, 16
K = CHUNKS * ROWS
#: Members of a bucket that one task compares with as many others.
BLOCK = 4096
#: Bits of an odd sketch: a power of two of at least four times the set's size, within these.
SKETCH = (1024, 1 << 16)
U64 = np.uint64


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, K + 1, dtype=U64)
    with np.errstate(over="ignore"):
        return tb.mix(i * U64(0x9E3779B97F4A7C15)) | U64(1), tb.mix(i * U64(0xD1B54A32D192ED03))


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """uint16 (sets, K): of each function's minimum over each set, BITS bits; zeros for an empty set."""
    sizes = np.diff(starts)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), K), np.uint16)
    if not len(full):
        return out
    times, plus = _seeds()
    with np.errstate(over="ignore"):
        for k in range(K):
            x = values * times[k] + plus[k]
            x ^= x >> U64(32)
            low = np.minimum.reduceat(x, starts[full])
            out[full, k] = (tb.mix(low) >> U64(64 - BITS)).astype(np.uint16)
    return out


def sketch_bits(n: int) -> int:
    return int(min(SKETCH[1], max(SKETCH[0], 1 << int(max(1, 4 * n) - 1).bit_length())))


def odd_sketch(values: np.ndarray) -> bytes:
    """Parity of the number of members at each of ``sketch_bits`` places."""
    m = sketch_bits(len(values))
    return np.packbits((np.bincount((values >> U64(17)) & U64(m - 1), minlength=m) & 1).astype(bool), bitorder="little").tobytes()


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, their set members, starts) by blocks of texts."""
    for i, j, data, offsets in tb.blocks(column):
        yield j - i, *tb.shingle_sets(*tb.words(data, offsets), width)


def _class_key(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """16 bytes for each set: equal for equal sets; two independent sums of mixed members and the size."""
    with np.errstate(over="ignore"):
        one = np.concatenate([[U64(0)], np.cumsum(tb.mix(values ^ U64(0xA5A5A5A5A5A5A5A5)))])
        two = np.concatenate([[U64(0)], np.cumsum(tb.mix(values + U64(0x632BE59BD9B4E019)))])
        a, b = one[starts[1:]] - one[starts[:-1]], two[starts[1:]] - two[starts[:-1]]
    raw = np.stack([a, tb.mix(b + np.diff(starts).astype(U64))], 1).tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(a))]


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for n, values, starts in _sets(batch.column(2), width):
                raw = signatures(values, starts).tobytes()
                step = 2 * K
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, n),
                        batch.column(1).slice(done, n),
                        pa.array(np.diff(starts)),
                        pa.array(_class_key(values, starts), pa.binary()),
                        pa.array([raw[step * i : step * i + step] for i in range(n)], pa.binary()),
                        pa.array([odd_sketch(values[starts[i] : starts[i + 1]]) for i in range(n)], pa.binary()),
                    ],
                    names=["doc_id", "digest", "n_shingles", "cls", "sig", "sketch"],
                )
                done += n

    return run


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """uint64 (sets, CHUNKS * ROWS): the chunk without each position that may differ (ERRORS = 1), packed and mixed."""
    out = np.empty((len(sig), CHUNKS * ROWS), U64)
    with np.errstate(over="ignore"):
        for c in range(CHUNKS):
            part = sig[:, c * ROWS : (c + 1) * ROWS].astype(U64)
            for hole in range(ROWS):
                key = np.zeros(len(sig), U64)
                for k in range(ROWS):
                    if k != hole:
                        key = (key << U64(BITS)) | part[:, k]
                out[:, c * ROWS + hole] = tb.mix(tb.mix(key) + U64(c * ROWS + hole + 1))
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, K)
        keys = bucket_keys(sig).view(np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["cid", "keys"])


def _fold(bits: np.ndarray) -> np.ndarray:
    """The sketches at half the length."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def possible(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes whose symmetric difference is at least ``differ`` can be similar enough.

    100 * i >= percent * u with i + u = n_a + n_b and u - i = d  <=>  d * (100 + percent) <= (100 - percent) * (n_a + n_b).
    """
    return differ * (100 + percent) <= (100 - percent) * (n_a + n_b)


def bounded(sk_a: list[bytes], sk_b: list[bytes], n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """For each pair whether its sketches leave it possible."""
    out = np.zeros(len(n_a), bool)
    for i, (x, y) in enumerate(zip(sk_a, sk_b, strict=True)):
        lo, hi = min(n_a[i], n_b[i]), max(n_a[i], n_b[i])
        if 100 * lo < percent * hi:
            continue
        p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        while len(p) > len(q):
            p = p[: len(p) // 2] ^ p[len(p) // 2 :]
        while len(q) > len(p):
            q = q[: len(q) // 2] ^ q[len(q) // 2 :]
        out[i] = int(np.bitwise_count(p ^ q).sum()) * (100 + percent) <= (100 - percent) * int(n_a[i] + n_b[i])
    return out


def _bound_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, s_a, s_b = batch.columns
            ok = bounded(s_a.to_pylist(), s_b.to_pylist(), n_a.to_numpy(), n_b.to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])

    return run


def first_slot(same: np.ndarray) -> np.ndarray:
    """Of each row of a comparison of signatures (pairs, K), the number of the first key that both have; -1 for none.

    A pair that shares several buckets is left to the bucket of this key alone.
    """
    bad = ROWS - same.reshape(-1, CHUNKS, ROWS).sum(2)
    chunk = (bad <= ERRORS).argmax(1)
    at = np.arange(len(same))
    hole = same.reshape(-1, CHUNKS, ROWS)[at, chunk].argmin(1)
    return np.where(bad[at, chunk] <= ERRORS, chunk * ROWS + np.where(bad[at, chunk] == 0, 0, hole), -1)


def _cross(percent: int):
    """Pairs of one bucket's block (or two blocks) that lie in different components and that the bound leaves possible."""

    def run(table: pa.Table) -> pa.Table:
        n = table["n_shingles"].to_numpy()
        order = np.argsort(n, kind="stable")
        n = n[order]
        cid, comp, block = (table[c].to_numpy()[order] for c in ("cid", "comp", "blk"))
        one, two = table["lo"][0].as_py(), table["hi"][0].as_py()
        raw = table["sketch"].to_pylist()
        raw = [raw[i] for i in order]
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, K)[order]
        slot = table["slot"][0].as_py()
        width = np.array([len(x) for x in raw])
        level = {w: np.frombuffer(b"".join(raw[i] for i in np.flatnonzero(width == w)), np.uint8).reshape(-1, w) for w in np.unique(width)}
        begin = {w: int(np.searchsorted(width, w)) for w in level}
        folded = {w: _fold(x).copy().view(U64) for w, x in level.items()}
        plain = {w: x.copy().view(U64) for w, x in level.items()}
        found_a, found_b = [], []
        for i in range(len(n)):
            end = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
            for w, have in ((width[i], plain), (width[i] * 2, folded)):
                if w not in have:
                    continue
                lo, hi = max(i + 1, begin[w]), min(end, begin[w] + len(have[w]))
                if lo >= hi:
                    continue
                js = np.arange(lo, hi)
                js = js[comp[js] != comp[i]]
                if one != two:
                    js = js[block[js] != block[i]]
                if not len(js):
                    continue
                mine = plain[width[i]][i - begin[width[i]]]
                apart = np.bitwise_count(have[w][js - begin[w]] ^ mine).sum(1, dtype=np.int64)
                js = js[possible(n[i], n[js], apart, percent)]
                js = js[first_slot(sig[js] == sig[i]) == slot]
                found_a.append(np.minimum(cid[i], cid[js]))
                found_b.append(np.maximum(cid[i], cid[js]))
        a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
        b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for n, values, starts in _sets(batch.column(1), width):
                members = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), pa.array(_class_key(values, starts), pa.binary()), members], names=["doc_id", "cls", "members"])
                done += n

    return run


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets satisfy 100 * intersection >= percent * union, written to the shared folder."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "cls", "min_doc"), "cid")
    wanted = cut(wanted, "wanted")
    ids = small(wanted.select(F.col("min_doc").alias("doc_id")).distinct(), 24)
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    sets = texts.mapInArrow(_full_sets(width), "doc_id long, cls binary, members array<long>").dropDuplicates(["cls"]).drop("doc_id")
    sets = wanted.select("cid", "cls").join(sets, "cls").select("cid", "members")
    sets = cut(sets, "sets")
    one, two = sets.select(F.col("cid").alias("a"), F.col("members").alias("s")), sets.select(F.col("cid").alias("b"), F.col("members").alias("t"))
    both = F.size(F.array_intersect("s", "t")).cast("long")
    sure = cut(pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("s") + F.size("t") - both)).select("a", "b"), "links")
    remove(wanted, sets)
    return sure


def _components(spark: SparkSession, docs: DataFrame, width: int, percent: int, digest: Column) -> DataFrame:
    """doc_id, digest, n_shingles, component_id, first_digest for every row of ``docs``.

    (component_id, first_digest) is the least (doc_id, digest) of the row's component, nulls last; first_digest is null for empty sets.
    """
    schema = "doc_id long, digest binary, n_shingles long, cls binary, sig binary, sketch binary"
    described = cut_in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), "text").mapInArrow(_describe(width), schema), "described")
    full = described.where("n_shingles > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    classes = full.groupBy("cls").agg(least.alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("min_doc", F.col("least.doc_id")).withColumn("cid", F.monotonically_increasing_id()), "classes")

    members = classes.select("cid", "sig").mapInArrow(_keys, "cid long, keys array<long>").select("cid", F.posexplode("keys").alias("slot", "key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("rep")).where("n > 1")
    met = cut(members.join(buckets, "key"), "met")

    slim = classes.select("cid", "n_shingles", "sketch")

    def side(name: str) -> DataFrame:
        return slim.select(F.col("cid").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    stars = met.where("cid <> rep").select(F.col("rep").alias("a"), F.col("cid").alias("b")).distinct()
    stars = stars.join(side("a"), "a").join(side("b"), "b").where("100 * least(n_a, n_b) >= %d * greatest(n_a, n_b)" % percent)
    stars = cut(stars.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_bound_pairs(percent), "a long, b long"), "stars")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    links = confirm(stars, docs, classes, width, percent)
    comps = cut(connected_components(links).withColumnRenamed("node", "cid"), "comps")

    # what is left: buckets whose members are in several components
    placed = met.where("n > 2").join(comps, "cid", "left").select("key", "slot", "n", "cid", F.coalesce("component", "cid").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = placed.join(mixed, "key", "left_semi").join(classes.select("cid", "n_shingles", "sketch", "sig"), "cid")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = rest.withColumn("blk", F.when(parts <= 1, 0).otherwise(F.pmod(F.xxhash64("cid"), parts)).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rest = rest.select("key", "slot", "cid", "comp", "n_shingles", "sketch", "sig", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
    left = rest.groupBy("key", "lo", "hi").applyInArrow(_cross(percent), "a long, b long").distinct()
    left = cut(left, "left")
    more = confirm(left, docs, classes, width, percent)
    settled = cut(connected_components(links.unionByName(more)).withColumnRenamed("node", "cid"), "comps")
    remove(met, stars, links, comps, left, more)

    named = classes.select("cls", "cid", "least").join(settled, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    firsts = named.groupBy("component").agg(F.min("least").alias("first"))
    named = named.join(firsts, "component").select("cls", F.col("first.doc_id").alias("component_id"), F.col("first.digest").alias("first_digest"))
    linked = full.select("doc_id", "digest", "n_shingles", "cls").join(named, "cls").drop("cls")
    alone = described.where("n_shingles = 0").select("doc_id", "digest", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("first_digest"))
    return linked.unionByName(alone)


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id long, text string, any more columns).

    Texts are linked if 100 * |intersection| >= percent * |union| of their sets of ``width``-word shingles.  Null, empty
    and blank texts have an empty set and are linked with nothing: they are their own component, and kept.  A text of fewer
    words than ``width`` is one shingle.  Equal sets are one class, so copies cost one row each.  Repeated rows share
    their component and are each returned.  Rows with a null doc_id get their class's component and are not kept; a class of
    nothing but null ids is linked with no other class (component_id null, kept true).  No rows give no rows.
    """
    near = _components(spark, docs, width, percent, F.lit(None).cast("binary"))
    return near.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` from each component that :func:`near_duplicates` finds: the least by doc_id (nulls last), then by md5 of the text.

    A row is removed for itself and not for its doc_id, so an unrelated text under the same doc_id stays.  Rows that repeat both doc_id and
    text are kept once.  Rows without words are no one's copies: they stay, once for each doc_id and text, and all of those with a null doc_id.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    near = cut(_components(spark, docs, width, percent, digest), "near")
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("first_digest"))
    gone = near.where((F.col("n_shingles") > 0) & ~first).select(F.col("doc_id").alias("gone_id__"), F.col("digest").alias("gone_digest__")).distinct()
    own_id = docs["doc_id"].cast("long")
    left = docs.join(small(gone, 48), own_id.eqNullSafe(F.col("gone_id__")) & (digest == F.col("gone_digest__")), "left_anti")
    again = near.where("n_shingles > 0 or doc_id is not null").groupBy("doc_id", "digest").count().where("count > 1")
    again = small(again.select(F.col("doc_id").alias("again_id__"), F.col("digest").alias("again_digest__")), 48)
    same = own_id.eqNullSafe(F.col("again_id__")) & (digest == F.col("again_digest__"))
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


#: Every pair that shares a shingle, counted: the definition itself, for 2-word shingles at 0.8.
SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then w else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end) s from w),
n as (select doc_id, count(*) n from s group by 1),
i as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r as (select a, a b from e union select r.a, e.b from r join e on e.a = r.b),
c as (select a doc_id, min(b) c from r group by 1)
select w.doc_id, coalesce(n.n, 0) n_shingles, coalesce(c.c, w.doc_id) component_id, w.doc_id = coalesce(c.c, w.doc_id) kept
from w left join n using (doc_id) left join c using (doc_id)
"""
