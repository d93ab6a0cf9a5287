import collections
import math
import re

import pyarrow as pa
from test_learned import plain_features, plain_score
from test_minhash import brute

import corpus_pipeline
from sparkreel.llm import labelled, packing, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_order_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts, frames = docs.columns, [docs.count()], []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        frames.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "packing"]
    assert counts[:5] == sorted(counts[:5], reverse=True) and counts[4] < counts[0]
    left = {r.doc_id: r.text for r in frames[3].collect()}
    packed = collections.Counter()
    for r in frames[4].collect():
        packed[r.doc_id] += r.length
    assert packed == {d: len(t.split()) + 1 for d, t in left.items()}
    assert len(set(left.values())) == len(left)
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, frames[4].collect()))
    assert packing.BLOCK > 0


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def plain_leaks(docs, items):
    """Documents in which 13 aligned tokens of an item differ in 2 at most, found along the diagonals of equal runs of 4."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    runs = collections.defaultdict(list)
    words = {i: split(t) for i, t in items}
    for i, b in words.items():
        for q in range(len(b) - 3):
            runs[tuple(b[q : q + 4])].append((i, q))
    out = set()
    for d, t in docs:
        a = split(t)
        for i, shift in {(i, p - q) for p in range(len(a) - 3) for i, q in runs.get(tuple(a[p : p + 4]), ())}:
            b = words[i]
            width = min(13, len(b))
            same = [0 <= k + shift < len(a) and a[k + shift] == x for k, x in enumerate(b)]
            need = width if width < 13 else 11
            if len(b) >= 8 and any(sum(same[q : q + width]) >= need and q + shift >= 0 and q + shift + width <= len(a) for q in range(len(b) - width + 1)):
                out.add(d)
    return out


def test_stages_agree_with_plain_versions(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = labelled.learned(toxicity.Model, toxicity.fit, docs, labels, "toxic", 4, 2, 8000)

    def weight(feature):
        text = " ".join(w.decode() for w in feature[1:]) if feature[0] != "s" else f"{feature[1].decode()} x {feature[2].decode()}"
        bins = [b for b, _ in toxicity.features(*toxicity.tb.text_bytes(pa.array([text])))]
        at = (bins[0] if feature[0] == "w" else bins[1] if feature[0] == "p" else bins[2])[0]
        return at, float(toxic.weights[toxic.bins == at].sum())

    known = {f: weight(f) for t in rows.values() for f in plain_features(t.text)}
    score = lambda t: toxic.bias + sum(dict(known[f] for f in plain_features(t)).values())  # noqa: E731  a bin counts once
    left = {d: r.text for d, r in rows.items() if 1 / (1 + math.exp(-score(r.text))) < 0.3}
    stage = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert sorted(r.doc_id for r in stage.collect()) == sorted(left) and len(left) < len(rows)

    net = labelled.learned(quality.Model, quality.fit, stage, labels, "quality", 5, 0, 3000)
    scores = {d: plain_score(net, t) for d, t in left.items() if len(t) < 4000}
    kept = {r.doc_id for r in corpus_pipeline.keep_quality(spark, stage, SF).collect()}
    assert all((d in kept) == (s >= 0.3) for d, s in scores.items() if abs(s - 0.3) > 1e-4) and len(scores) > 100
    left = {d: t for d, t in left.items() if d in kept}
    stage = stage.where(stage["doc_id"].isin(list(kept)))

    classes = brute(list(left.items()), 5)
    least = {d: c for (d, _), (n, c) in classes.items() if n}
    want = {d for d in left if least.get(d, d) == d}
    stage = corpus_pipeline.near_dedup(spark, stage, SF)
    assert {r.doc_id for r in stage.collect()} == want and len(want) < len(left)

    want -= plain_leaks([(d, left[d]) for d in want], [(r.item_id, r.text) for r in items.collect()])
    stage = corpus_pipeline.drop_benchmark(spark, stage, SF)
    assert {r.doc_id for r in stage.collect()} == want

    packed = corpus_pipeline.pack(spark, stage, SF).collect()
    blocks = collections.defaultdict(list)
    for r in packed:
        blocks[r.block].append(r)
    for own in blocks.values():
        bins = []
        for r in sorted(own, key=lambda r: (-r.length, r.doc_id, r.start)):
            fits = [k for k, (room, sources, texts) in enumerate(bins) if room >= r.length and sources.count(rows[r.doc_id].source) < 4 and left[r.doc_id] not in texts]
            k = min(fits, key=lambda k: (bins[k][0], k), default=len(bins))
            if k == len(bins):
                bins.append((2048, [], set()))
            room, sources, texts = bins[k]
            assert (r.bin, r.offset) == (k, 2048 - room)
            bins[k] = (room - r.length, [*sources, rows[r.doc_id].source], texts | {left[r.doc_id]})
