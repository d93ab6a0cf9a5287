"""Labelled rows to learn from, and scoring of every row: what the two text classifiers share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut_in_small_batches, folds

T = TypeVar("T")
#: Bytes of text that a classifier learns from, at most, unless its caller says otherwise; and of one text.
TRAIN_BYTES, PIECE_BYTES = 48 << 20, 1 << 20


def share(sizes: list[int], most: int) -> int:
    """The greatest length to which texts of these sizes can be shortened so that together they fit in ``most``."""
    left, n = most, len(sizes)
    for i, size in enumerate(sorted(sizes)):
        if size * (n - i) > left:
            return left // (n - i)
        left -= size
    return max(sizes, default=0)


def sample_frame(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(y, text) of labelled documents outside the held-out fold, in the order of a hash of doc_id, in one partition.

    At most ``rows`` of them, one row a doc_id (the text of least md5), and at most ``most_bytes`` of text together.  No document
    is left out for its size: if they don't fit, the longest texts give their first bytes only, of one length, and of one text never
    more than PIECE_BYTES are taken.  Several labels of one doc_id: the least counts.  Null labels and null doc_ids are no labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(folds(modulus) != held).groupBy("doc_id").agg(F.min("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = bounded_sample(known, "doc_id", rows)
    texts = texts.join(F.broadcast(known), "doc_id")  # at most `rows` rows of 12 bytes
    digest = F.md5(F.col("text").cast("binary"))
    least = texts.groupBy("doc_id").agg(F.min(F.struct(digest.alias("digest"), F.octet_length("text").alias("n"))).alias("least"))
    picked = [(r["doc_id"], r["least"]["digest"], r["least"]["n"]) for r in least.collect()]  # at most `rows` rows
    if not picked:
        return docs.sparkSession.createDataFrame([], "y int, text string")
    most = min(PIECE_BYTES, share([n for _, _, n in picked], most_bytes))
    if not most and any(n for _, _, n in picked):
        raise ValueError(f"{len(picked)} labelled texts don't fit in {most_bytes} bytes, not even a byte of each")
    one = F.broadcast(docs.sparkSession.createDataFrame([(d, m) for d, m, _ in picked], "doc_id long, digest string"))
    short = F.make_valid_utf8(F.substring(F.col("text").cast("binary"), 1, most).cast("string"))
    texts = texts.withColumn("digest", digest).join(one, ["doc_id", "digest"])
    texts = texts.select("doc_id", "y", F.when(F.octet_length("text") <= most, F.col("text")).otherwise(short).alias("text")).dropDuplicates(["doc_id"])
    return texts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(len(picked)).select("y", "text")


def sample(*args, **kwargs) -> tuple[pa.Array, list[int]]:
    """(texts, labels) of :func:`sample_frame`."""
    got = sample_frame(*args, **kwargs).toArrow()
    return got["text"].combine_chunks(), got["y"].to_pylist()


def learned(kind: type[T], fit: Callable[[pa.Array, list[int]], T], docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int, most_bytes: int = TRAIN_BYTES) -> T:
    """``fit`` of a sample, made by one task on an executor; only the model's fields, which are small, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=pa.schema([("y", pa.int32()), ("text", pa.string())]))
        text, y = table["text"].combine_chunks(), table["y"].to_pylist()
        del table
        model = fit(text, y)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(vars(model))], pa.binary())})

    rows = sample_frame(docs, labels, label, modulus, held, rows, most_bytes).mapInArrow(run, "model binary").collect()
    return kind(**pickle.loads(rows[0]["model"])) if rows else fit(pa.array([], pa.string()), [])


def scored(docs: DataFrame, score: Callable[[pa.Array], object], modulus: int, held: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; ``score`` maps a column of texts to probabilities."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    out = cut_in_small_batches(out.hint("rebalance"), "scores")  # rows of 16 bytes: few files, not one for each part of the texts
    return out.select("doc_id", F.coalesce(folds(modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, score: Callable[[pa.Array], object], keep: Callable[[object], object]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score ``keep`` accepts, written to the shared folder."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(score(batch.column(at)))))

    return cut_in_small_batches(docs.mapInArrow(run, docs.schema), "kept")
