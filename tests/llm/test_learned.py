"""HTML text, nearest neighbours and the two classifiers: fixtures, brute force and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkreel.llm import ann, htmltext, labelled, quality, toxicity
from sparkreel.llm.htmltext import main_text

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score string"


# html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><nav><ul><li><a href=x>Home</a></li></ul></nav>
<main><article class="post"><header><h1>Title &amp; more</h1><span>by me</span></header><p>Hello
 world <a href="y">link</a>. <p>Second<br>para<ul><li>One<li>Two &lt;b&gt;</ul><aside>side</aside><div class="ad">Buy</div>
<form><p>f</p></form><p class="notice">Note<p>Last.<script>var a="</p><p>no";</script></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>bad comment</p></div></section></main><footer>foot</footer></body></html>"""


@pytest.mark.parametrize(
    "page,text",
    [
        (PAGE, "Title & more\n\nHello world link.\n\nSecond para\n\nOne\n\nTwo <b>\n\nLast."),
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain &amp; text", "plain & text"),
        ("<body><div id=menu><a>Menu</a></div><div><h2>Head</h2><p>" + "word " * 30 + "<p>Short.</div><div class='footer'>x</div>", "Head\n\n" + ("word " * 30).strip() + "\n\nShort."),
        ("<article><p>cut <b>off here", "cut off here"),
        ("<article><p>a</p><nav>never closed</article><p>out", "a"),
        ("<article><h1>x</h1><div class=ad>1<div>2</div>3</div><p>y</p></article>", "x\n\ny"),
        ('<article><p title="a > b">q</p><!-- <p>no</p> --><p>r < s</p></article>', "q\n\nr < s"),
        ("<nav>only menu</nav>", ""),
        ('<article><div class="article-header"><h1>t</h1></div><div class="main-menu">m</div><p class="no-ads">k</p><div class="postComments">c</div></article>', "t\n\nk"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_main_text_beside_teaser_articles():
    main = [f"Sentence {k} of the main text, which no article element marks at all." for k in range(6)]
    cards = "".join(f'<article class="card"><h3><a href="/{k}">Teaser {k}</a></h3><p>Short lead {k}.</p></article>' for k in range(40))
    page = f"<body><div class=content>{''.join(f'<p>{x}</p>' for x in main)}</div><hr><ul>{'<li><a href=x>y</a>' * 3}</ul>%s</body>"
    assert main_text(page % cards[: cards.index("</article>") + 10]) == "\n\n".join(main)
    assert all(x in main_text(page % cards) for x in main)  # many cards together have more text, none alone
    # an article with more text than its surroundings is still all that comes out
    assert main_text(page % f"<article><p>{'word ' * 200}</p><p>End.</p></article>") == ("word " * 200).strip() + "\n\nEnd."


def test_lines_of_links_inside_the_main_text():
    text = "word " * 30
    menu = "".join(f"<div><a href=/{k}>Menu {k}</a></div>" for k in range(9))
    page = f"<body>{menu}<h1><a href=#t>Title</a></h1><p>{text}</p><p><a href=x>Whole paragraph</a></p><ul><li><a href=y>One item</a><li>Two</ul><div class=ad><a href=z>Buy</a></div><p>{text}</p>{menu}</body>"
    assert main_text(page) == "\n\n".join(["Title", text.strip(), "Whole paragraph", "One item", "Two", text.strip()])
    assert main_text(f"<body>{menu}<p>{text}</p>{menu}</body>") == text.strip()
    assert main_text(f"<body>{menu}<p><a href=x>First</a><p>{text}</p></body>") == "First\n\n" + text.strip()


def test_surge_and_dive():
    assert htmltext.spans([0, 5, 0, 0, 0, 60, 50, 0, 40, 0, 0, 0, 3], 3, 86) == [(3, 9)]
    assert htmltext.spans([0, 5, 0, 0, 0, 9], 3, 86) == [(3, 6)]
    assert htmltext.spans([], 3, 86) == [] and htmltext.spans([0, 0], 3, 86) == []


def test_extract_every_row(spark):
    long = "<article>" + "".join(f"<p>p{i}</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", long)]
    out = htmltext.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(out) == 4 and out[0] == out[1]
    assert [r.n_chars for r in out if r.page_id is None] == [0]
    assert next(r.text for r in out if r.page_id == 2).count("\n\n") == 29_999
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# nearest neighbours


def test_recall_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    out = ann.nearest(table, table.where("vec_id % 25 = 0"), 10).collect()
    hits = total = 0
    for q in (q for q in rows if q % 25 == 0):
        exact = sorted((math.sqrt(float(((rows[v] - rows[q]) ** 2).sum())), v) for v in rows if v != q)
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - math.sqrt(float(((rows[r.vec_id] - rows[q]) ** 2).sum()))) < 1e-12 for r in mine)
        hits, total = hits + len({v for _, v in exact[:10]} & {r.vec_id for r in mine}), total + 10
    assert hits / total >= 0.9


def test_ties_bad_vectors_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, 2.0, float(i // 40)]) for i in range(1, 120)]
    bad = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 1.0]), (203, [nan, 1.0, 1.0]), (204, [1.0, inf, 1.0]), (205, [1.0]), (206, []), (None, [1.0, 2.0, 0.0])]
    rows = spark.createDataFrame([(*r, "x") for r in good + bad + [good[0]]], "vec_id long, embedding array<double>, score string")
    old, ann.BLOCK_BYTES = ann.BLOCK_BYTES, 16 * 24
    try:
        out = ann.nearest(rows, rows.where("vec_id in (1, 2, 3, 50, 200, 201, 205) or vec_id is null"), 4).collect()
    finally:
        ann.BLOCK_BYTES = old
    got = {q: [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in out}}
    assert got == {1: [(k, 0.0) for k in (2, 3, 4, 5)], 2: [(k, 0.0) for k in (1, 3, 4, 5)], 3: [(k, 0.0) for k in (1, 2, 4, 5)], 50: [(k, 0.0) for k in (40, 41, 42, 43)]}


def test_few_and_no_vectors(spark):
    two = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1.0)]
    assert ann.nearest(two.limit(0), two.limit(0)).collect() == []


def test_rows_that_share_a_code_push_none_out():
    rng = np.random.default_rng(3)
    books = ann.train(rng.normal(size=(400, 8)).astype(np.float32), 8)
    base = rng.normal(size=8)
    rows = np.vstack([np.repeat(base[None], 100, 0), base + 0.2 * rng.normal(size=(100, 8))])  # 100 copies, before all others
    cell, codes = ann.encode(books, rows)
    at = np.flatnonzero(cell == cell[0])
    query = base + 0.6 * (rows[at[-1]] - base)
    block = ann.Block(books, cell[0], at, rows[at], codes[at])
    kinds = len(np.unique(codes[at], axis=0))
    for q_id, q in ((-1, query), (int(at[-1]), rows[at[-1]])):  # all codes are kept, so the answer is exact
        exact = sorted((float(np.sqrt(((rows[k] - q) ** 2).sum())), int(k)) for k in at if k != q_id)[:10]
        for keep in (None, kinds):
            assert [x.tolist() for x in next(block.search(np.array([q_id]), q[None], 10, keep))[1:2]] == [[k for _, k in exact]]
        some = next(block.search(np.array([q_id]), q[None], 200, 1))  # one code, but all its copies
        assert len(some[1]) >= np.unique(codes[at], axis=0, return_counts=True)[1].min()


def test_exact_search_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    out = ann.nearest(table, table.where("vec_id % 50 = 0"), 10, exact=True).collect()
    for q in (q for q in rows if q % 50 == 0):
        exact = sorted((math.sqrt(float(((rows[v] - rows[q]) ** 2).sum())), v) for v in rows if v != q)[:10]
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == [v for _, v in exact]


def test_recall_of_the_contracts_queries(spark):
    for sf in ("sf0.01", "sf0.1"):
        table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        got = table.toArrow()
        ids, x = got["vec_id"].to_numpy(), np.array(got["embedding"].to_pylist(), float)
        out = {(r.query_id, r.vec_id) for r in ann.nearest(table, table.where("vec_id % 100 = 0"), 10).collect()}
        hits = []
        for at in np.flatnonzero(ids % 100 == 0):
            far = ((x - x[at]) ** 2).sum(1)
            far[at] = np.inf
            hits += [(int(ids[at]), int(ids[k])) in out for k in np.lexsort((ids, far))[:10]]
        assert np.mean(hits) >= 0.9


def test_finite_vectors_of_any_size_take_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 300)]
    rows += [(1000, [1e25] * 8), (1001, [1e25] * 7 + [2e25]), (1002, [1e200] * 8), (1003, [1e-200] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest(table, table.where("vec_id >= 1000"), 10).collect()
    got = {q: {r["rank"]: (r.vec_id, r.score) for r in out if r.query_id == q} for q in (1000, 1001, 1002, 1003)}
    assert all(len(v) == 10 for v in got.values())
    assert got[1000][1] == (1001, 1e25) and got[1001][1] == (1000, 1e25)
    assert got[1003][1][1] < 10


# classifiers


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("run,label,modulus,held,least", [(quality.quality, "quality", 5, 0, 0.95), (toxicity.toxicity, "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, run, label, modulus, held, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in run(docs, labels).collect()}
    assert len(out) == docs.count()
    known = [(r.doc_id, r[label]) for r in labels.collect()]
    assert all(out[d].held_out == (zlib.crc32(str(d).encode()) % modulus == held) for d, _ in known)
    test = [(out[d].score, y) for d, y in known if out[d].held_out]
    assert auc(np.array([s for s, _ in test]), [y for _, y in test]) > least
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out.values())


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_odd_rows_and_tables(spark, run):
    docs = spark.createDataFrame([(1, "good text here", "en", "s", "x"), (1, "good text here", "en", "s", "x"), (2, None, None, None, None), (3, "", "", "", ""), (None, "idiot", "en", "s", "x"), (4, "word " * 100_000, "en", "s", "x")], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    out = run(docs, labels).collect()
    assert len(out) == 6 and not any(r.held_out for r in out if r.doc_id is None)
    assert all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1 and len({r.score for r in out if r.doc_id in (2, 3)}) == 1
    assert {r.score for r in run(docs, labels.limit(0)).collect()} == {0.5}
    assert run(docs.limit(0), labels).collect() == []


def test_sample_leaves_no_document_out(spark):
    ids = [d for d in range(200) if zlib.crc32(str(d).encode()) % 4 != 2]
    texts = {d: f"text {d}" for d in ids}
    rows = [(d, t) for d, t in texts.items() if d != ids[0]]
    labels = spark.createDataFrame([(d, d % 2) for d in ids], "doc_id long, toxic int")

    def taken(rows, most_bytes):
        got, y = labelled.sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", 4, 2, len(ids), most_bytes)
        assert len(got) == len(y)
        return got.to_pylist(), y

    plain, _ = taken([*rows, (ids[0], texts[ids[0]])], 10_000)
    assert sorted(plain) == sorted(texts.values())
    for at, d in enumerate([int(t.split()[1]) for t in plain]):  # each of them too long, wherever its hash puts it
        if at % 40 == 0:
            got, y = taken([(k, "é" * 9000 if k == d else t) for k, t in texts.items()], 10_000)
            assert got[:at] + got[at + 1 :] == plain[:at] + plain[at + 1 :] and set(got[at]) <= set("é\ufffd") and len(got[at]) > 3000
            assert sum(len(t.encode()) for t in got) <= 10_000 + 3 and y == [int(t.split()[1]) % 2 for t in plain]
    assert taken([*[(ids[3], texts[ids[3]])] * 500, (ids[3], "other"), *texts.items()], 10_000)[0].count("other") <= 1
    assert len(taken([*[(ids[3], texts[ids[3]])] * 500, *texts.items()], 10_000)[0]) == len(ids)  # copies take no one's place
    with pytest.raises(ValueError):
        taken(list(texts.items()), 10)
    assert [labelled.share(x, 10) for x in ([], [3, 4], [3, 9], [20, 20, 1], [10], [11])] == [0, 4, 7, 4, 10, 10]


def test_whole_text_counts():
    rng = random.Random(1)
    clean = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(5, 60))) for _ in range(400)]
    y = [i % 2 for i in range(400)]
    texts = pa.array([t + " vile" if k else t for t, k in zip(clean, y, strict=True)])
    model = toxicity.fit(texts, y)
    long = "w1 " * 50_000
    a, b, c = toxicity.score(model, pa.array([long, long + "vile", "VILE! " + long]))
    assert a < 0.3 <= b and abs(b - c) < 0.2
    junk = pa.array(["### %% $$$ " * 40 if k == 0 else t * 5 for t, k in zip(clean, y, strict=True)])
    net = quality.fit(junk, y, passes=6)
    good, tail = quality.score(net, pa.array([long, "### %% $$$ " * 4000]))
    assert good > 0.5 > tail


def test_rare_words_are_learned():
    rng = random.Random(2)
    clean = [" ".join(f"w{rng.randrange(50)}" for _ in range(20)) for _ in range(300)]
    rare = {n: [f"rare{n}" for _ in range(n)] for n in (1, 2, 3, 4)}
    texts = [t + " vile" for t in clean[:60]] + [f"{t} {w[0]}" for (w, t) in zip([w for w in rare.values() for _ in w], clean[60:70], strict=True)] + clean[70:]
    y = [int(k < 70) for k in range(300)]
    order = rng.sample(range(300), 300)
    model = toxicity.fit(pa.array([texts[k] for k in order]), [y[k] for k in order])

    def weight(word):
        at = toxicity.features(*toxicity.tb.text_bytes(pa.array([word])))[0][0][0]
        return float(model.weights[model.bins == at].sum())

    assert weight("rare1") == 0 and min(weight("rare2"), weight("rare3"), weight("rare4")) > 0


def test_stages_keep_columns_and_reject(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = toxicity.without_toxic(docs, labels)
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(d for d, p in scores.items() if not p)
    good = quality.of_quality(docs, labels)
    scores = {r.doc_id: r.predicted for r in quality.quality(docs, labels).collect()}
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.select("doc_id").collect()) == sorted(d for d, p in scores.items() if p)


# the quality network, byte by byte


def plain_score(model, text):
    """The network as its definition says, one window at a time."""
    data = list(text.encode())
    steps = -(-(len(data) + quality.WIDTH - 1) // quality.STEP)
    data += [0] * (steps * quality.STEP - len(data))
    top = []
    for s in range(steps):
        ends = [p for p in range(s * quality.STEP, (s + 1) * quality.STEP) if p + quality.WIDTH <= len(data)]
        top.append([max(sum(float(model.place[w, data[p + w], f]) for w in range(quality.WIDTH)) for p in ends) + float(model.bias[f]) for f in range(quality.FILTERS)])
    chunks = [[max(0.0, a, b) for a, b in zip(top[s], top[min(s + 1, steps - 1)], strict=True)] for s in range(steps)]
    feats = [sum(c[f] for c in chunks) / steps for f in range(quality.FILTERS)] + [max(c[f] for c in chunks) for f in range(quality.FILTERS)]
    return 1 / (1 + math.exp(-sum(x * float(w) for x, w in zip(feats, model.out, strict=True)) - model.out_bias))


@pytest.fixture(scope="module")
def net():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc deé #%") for _ in range(rng.choice([0, 3, 200, 251, 252, 256, 257, 600, 1100]))) for _ in range(120)]
    return quality.fit(pa.array(texts), [k % 2 for k in range(120)], passes=2), texts


def test_network_agrees_with_the_plain_one(net):
    model, texts = net
    got = quality.score(model, pa.array(texts[:30]))
    assert np.allclose(got, [plain_score(model, t) for t in texts[:30]], atol=1e-5)


def test_scores_depend_on_the_text_alone(net, spark):
    model, texts = net
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + texts + [None, "", "x" * 3_000_000]
    whole = quality.score(model, pa.array(texts))
    assert (quality.score(model, pa.array(texts[::-1]))[::-1] == whole).all()
    for size in (1, 7, 1000):
        assert (np.concatenate([quality.score(model, pa.array(texts[k : k + size], pa.string())) for k in range(0, len(texts), size)]) == whole).all()


# FTRL as plain dictionaries


def plain_words(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    out, word = [], b""
    for b in [*data, 32]:
        if b < 128 and not chr(b).isalnum():
            out, word = out + [word] * bool(word), b""
        else:
            word += bytes([b])
    return out


def plain_features(text):
    w = plain_words(text)
    return {("w", a) for a in w} | {("p", a, b) for a, b in zip(w, w[1:], strict=False)} | {("s", a, b) for a, b in zip(w, w[2:], strict=False)}


def test_ftrl_agrees_with_the_plain_one():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Ab", "cd,", "éf", "gh", f"x{rng.randrange(30)}"]) for _ in range(rng.randrange(0, 25))) for _ in range(150)]
    texts = [t + " Vile!" if k % 3 == 0 else t for k, t in enumerate(texts)] + [None, ""]
    y = [int(k % 3 == 0) for k in range(150)] + [0, 0]
    passes, alpha, beta, l1, l2 = 4, 1.0, 1.0, 1.5, 0.2
    z, n = {}, {}

    def weight(f):
        x, limit = z.get(f, 0.0), 0.0 if f == "bias" else l1
        return 0.0 if abs(x) <= limit else -(x - math.copysign(limit, x)) / ((beta + math.sqrt(n.get(f, 0.0))) / alpha + l2)

    def chance(text):
        return 1 / (1 + math.exp(-max(-35, min(35, sum(map(weight, [*plain_features(text), "bias"]))))))

    for _ in range(passes):
        for text, label in zip(texts, y, strict=True):
            g, used = chance(text) - label, [*plain_features(text), "bias"]
            for f, w in [(f, weight(f)) for f in used]:
                have = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(have + g * g) - math.sqrt(have)) / alpha * w
                n[f] = have + g * g
    model = toxicity.fit(pa.array(texts), y, passes, alpha, beta, l1, l2)
    assert np.allclose(toxicity.score(model, pa.array(texts)), [chance(t) for t in texts], atol=1e-9)


@pytest.mark.parametrize("stage,run,keeps", [(toxicity.without_toxic, toxicity.toxicity, 0), (quality.of_quality, quality.quality, 1)])
def test_stages_on_odd_rows(spark, stage, run, keeps):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(20)) + (" ## %% $$" * 5 + " vile" if k % 2 else "") for k in range(60)]
    rows = [(k, t, "en", "s", "x") for k, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", "x"), (2, texts[2], "en", "s", "y"), (100, None, None, None, None), (101, "", "", "", ""), (None, texts[4], "en", "s", "x"), (None, texts[5], "en", "s", "x"), (102, "w1 " * 400_000, "en", "s", "x"), (103, "## vile $$ " * 200_000, "en", "s", "x")]
    docs = spark.createDataFrame(rows, DOCS)  # with a column that is called like the result's
    labels = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    scored = {}
    for r in run(docs, labels).collect():
        scored.setdefault(r.doc_id, set()).add(r.predicted)
    left = stage(docs, labels)
    assert left.columns == docs.columns
    got = sorted(map(tuple, left.collect()), key=str)
    # ids with one verdict: all their rows stay or go; without an id, the text decides
    by_text = {t: min(scored[k]) for k, t in enumerate(texts)}
    want = [r for r in rows if (by_text[r[1]] if r[0] is None else min(scored[r[0]])) == keeps]
    assert all(len(v) == 1 for k, v in scored.items() if k is not None) and got == sorted(want, key=str) and 0 < len(got) < len(rows)
    assert stage(docs.limit(0), labels).collect() == [] and stage(docs, labels.limit(0)).count() == len(rows)
