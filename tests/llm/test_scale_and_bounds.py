"""Bounds that prune without loss, kernels that take linear time, and whole jobs on odd tables."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.llm import common, decontam, html_extract, langid, neardup, packing, quality, topk, toxicity, warc
from test_llm import DATA, DOCS, ODD, classes_by_force


def edited(rng, words, share):
    """The words with about `share` of them replaced by new ones."""
    return [f"n{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


def test_bound_keeps_every_pair_that_may_be_linked(spark):
    rng = np.random.default_rng(11)
    rows, runs = [], {}
    for i in range(80):
        base = np.arange(i % 4 * 1000, i % 4 * 1000 + 60 + 40 * (i % 4)).astype(np.uint32)
        own = np.unique(np.where(rng.random(len(base)) < rng.choice([0.02, 0.06, 0.12, 0.3]), rng.integers(0, 1 << 32, len(base)), base)).astype("<u4")
        weight = rng.integers(1, 5, len(own)).astype("<f4") if i % 3 == 0 else np.ones(len(own), "<f4")
        runs[i] = (own, weight)
        rows.append((i, own.tobytes(), b"" if (weight == 1).all() else weight.tobytes()))
    b = neardup.bounds(spark.createDataFrame(rows, "node long, runs binary, weights binary"))
    x, y = b.alias("x"), b.alias("y")
    kept = {(r.i, r.j) for r in x.join(y, F.expr("x.node < y.node") & neardup.possible("x", "y", 0.8)).selectExpr("x.node as i", "y.node as j").collect()}
    near = far = 0
    for i in range(80):
        for j in range(i + 1, 80):
            likeness = max(neardup.similarity(*runs[i], *runs[j]))
            near += likeness >= 0.8
            far += likeness < 0.6 and (i, j) in kept and i % 3 > 0 and j % 3 > 0  # weights loosen the bound
            assert likeness < 0.8 or (i, j) in kept
    assert near > 50 and far < 20


def test_groups_of_near_copies_match_brute_force(spark):
    """Copies whose edits differ, so that many share buckets without being linked, in several connected or separate groups."""
    rng = np.random.default_rng(12)
    rows = []
    for g in range(6):
        words = [f"g{g}w{k}" for k in range(60)]
        centre = edited(rng, words, 0.03)
        rows += [(len(rows) + k, " ".join(edited(rng, centre if k % 2 else words, rng.choice([0.005, 0.01, 0.02, 0.04])))) for k in range(60)]
    rows += [(len(rows) + k, t) for k, (_, t) in enumerate(rows[::7])]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), common.shared_dir(spark)).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == classes_by_force(rows)


def test_sequences_of_very_short_texts_are_full(spark):
    table = spark.createDataFrame([(i, "a b") for i in range(9000)], "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(table).toPandas()
    by = got.groupby("sequence_id")
    assert by.length.sum().sum() / by.padded_to.first().sum() > 0.99 and len(got) >= 9000


def test_numerals_are_no_letters(spark):
    docs = common.table(spark, DATA, "documents")
    table = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ 12 ٣"), (3, "der Hund und die Katze 12 ½ schlafen")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(table, langid.train(docs)).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und"


@pytest.mark.parametrize("unit", ["<div>", "<a '", '<a "> " ', "<div><li></li>", "<b><div>", "<td><div>", "<p><table><td><div>"])
def test_hostile_pages_take_linear_time(unit):
    took = []
    for n in (2_000, 16_000):
        began = time.process_time()
        html_extract.parse(unit * n)
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)


def test_text_of_formulas_stays():
    nodes = html_extract.listed(html_extract.parse("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p></article>"))
    assert html_extract.joined(nodes, np.ones(len(nodes), bool)) == "Let x=2 hold"


SAID = ["The river rose for three days before the first bridge gave way, and the town moved uphill.", "Nobody had kept the old maps, so the engineers measured every street again by hand.", "By spring the market had reopened in the yard of the school, with half of its stalls."]
LAYOUTS = [
    "<html><body><div class='top-bar'><a href='/'>Home</a> <a href='/n'>News</a></div><div class='layout'><div class='col-left'><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></div><div class='story'><h1>{t}</h1><p>{0}</p><p>{1}</p><p>{2}</p></div></div><div class='bottom-links'><a href='/i'>Imprint</a></div></body></html>",
    "<body><header><nav><a href='/'>Start</a><a href='/x'>More</a></nav></header><main><h1>{t}</h1><section><p>{0}</p></section><section><p>{1}</p><p>{2}</p></section></main><footer><p>All rights reserved.</p></footer></body>",
    "<body><table><tr><td><a href='/'>Index</a></td><td><a href='/p'>Photos</a></td></tr></table><article><h2>{t}</h2><p>{0}</p><blockquote>{1}</blockquote><p>{2}</p></article><form action='/s'><input name='q'><button>Search</button></form></body>",
    "<body><div id='cookie-consent'><p>We use cookies.</p><button>Accept</button></div><article><header><h1>{t}</h1></header><p>{0}</p><p>{1}</p><p>{2}</p></article><section class='comments'><h3>Comments</h3><div class='comment'><p>Great read, thanks a lot!</p></div></section></body>",
    "<body><div id='page'><div id='menu'><a href='/'>Home</a> | <a href='/c'>Contact</a></div><div id='main-content'><h1>{t}</h1><p>{0}<br>{1}</p><p>{2}</p></div><div class='sidebar'><h3>Popular</h3><ul><li><a href='/q'>Ten tricks</a></li></ul></div></div></body>",
]


def test_main_text_in_layouts_that_no_generator_wrote():
    """Word overlap with the article, on pages written by hand."""
    model = html_extract.train()
    got = html_extract.main_text(model, [x.format(*SAID, t="After the flood") for x in LAYOUTS])
    want = set(" ".join(["After the flood", *SAID]).split())
    for text in got:
        own = set(text.split())
        assert len(own & want) / len(want) > 0.95 and len(own - want) / max(1, len(own)) < 0.05, text


def test_archives_are_read_in_pieces_of_any_size():
    row = {"url": "http://a/", "payload_digest": "d", "first": None, "first_url": None}
    data = b"".join(warc.member(warc.record({**row, "page_id": i}, b"x" * i, "2020-01-01T00:00:00Z", str(i))) for i in range(50))
    for step in (1, 7, 1000, len(data)):
        got = [f["Page-Id"] for f, _ in warc.records(data[k : k + step] for k in range(0, len(data), step))]
        assert got == [str(i) for i in range(50)]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records([data[:-3]]))


def test_revisits_name_their_response():
    first = {"page_id": 3, "url": "http://b/", "payload_digest": "d", "first": 3, "first_url": "http://b/"}
    later = {**first, "page_id": 5, "url": "http://a/"}
    (a, body), (b, rest) = (next(warc.records([warc.member(warc.record(r, b"payload", "2020-01-01T00:00:00Z", "p"))])) for r in (first, later))
    assert a["WARC-Type"] == "response" and body.endswith(b"payload") and not rest.endswith(b"payload")
    assert b["WARC-Refers-To"] == a["WARC-Record-ID"] != b["WARC-Record-ID"] and b["WARC-Refers-To-Target-URI"] == "http://b/"


def test_law_of_clean_segments():
    """lambda solves the sum over the scores, and the law tells how often a maximum is exceeded."""
    rng = np.random.default_rng(13)
    n, drift, hit, p = 400, 0.25, 2.0, 0.05
    texts = rng.random((3000, n)) < p
    best = np.array([max((s for *_, s in toxicity.segments(np.flatnonzero(t), np.full(t.sum(), hit), drift)), default=0.0) for t in texts])
    rate, constant = toxicity.law(np.full(3000, float(n)), best, np.full(int(texts.sum()), hit), {"t": hit}, drift)
    share = texts.mean()
    assert share * np.exp(rate * hit) + (1 - share) * np.exp(-rate * drift) == pytest.approx(1, abs=1e-6)
    for s in (6.0, 8.0):
        said = 1 - np.exp(-constant * n * np.exp(-rate * s))
        assert said == pytest.approx((best >= s).mean(), rel=0.5, abs=0.01)


def test_toxic_documents_that_are_held_out_are_found(spark):
    docs, known = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = toxicity.train(docs, known, common.shared_dir(spark))
    got = toxicity.score(docs, model).where("held_out").join(known, "doc_id").toPandas()
    found = got.predicted == 1
    assert (found & (got.toxic == 1)).sum() / (got.toxic == 1).sum() > 0.75 and (got.toxic[found] == 1).mean() > 0.9


def test_index_of_many_items_is_quick():
    rng = np.random.default_rng(14)
    names = np.array([f"w{k}" for k in range(5000)])
    texts = [" ".join(names[rng.integers(0, 5000, 20)]) for _ in range(20_000)]
    began = time.process_time()
    items = decontam.Items(list(range(20_000)), texts)
    assert time.process_time() - began < 15
    got = items.matches(pa.array([f"before {texts[7]} after"], pa.large_string()))
    assert [(r, i) for r, i, _ in got] == [(0, 7)]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_tables(spark, empty):
    import corpus_pipeline

    rows = [] if empty else [(i, t, "en", "s", 0, 0.0, "x", 1, "y") for i, t in ODD]
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() >= 0 and (name == "packing" or out.columns == docs.columns)
        assert not empty or out.isEmpty()


@pytest.mark.parametrize("box_bytes", [topk.BOX_BYTES, 900])
def test_top_k_by_groups_of_boxes_and_slices_of_equal_rows(spark, box_bytes):
    """Boxes in one and in two levels, many blocks of queries a shard, a third of the rows equal, ids that repeat."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-500, 500, 4)]) for i in range(400)] + [(1000 + i % 150, [7.0, 7.0, 7.0, 7.0]) for i in range(200)] + [(2000, [1.0, 2.0]), (2001, [3.0, -4.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").select("vec_id", F.col("v").cast("array<long>").alias("v"))
    queries = df.where("vec_id % 5 = 0")
    got = {}
    for r in topk.top_k(df, queries, common.shared_dir(spark), shard_rows=25, block_queries=7, box_bytes=box_bytes).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert len(got) == 111
    for q, best in got.items():
        query = min(v for i, v in rows if i == q)
        want = sorted((-int(np.dot(v, query)), i) for i, v in rows if i != q and len(v) == len(query))[:5]
        assert [(s, i) for _, s, i in sorted(best)] == want


def test_operators_leave_clashing_columns_alone(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0], i, [0], "x") for i in range(120)], "vec_id long, embedding array<double>, v int, q array<int>, shard string")
    df = topk.scaled(vectors)
    assert topk.top_k(df, df.where("vec_id % 50 = 0"), common.shared_dir(spark)).count() == 15
    items = spark.createDataFrame([(1, "one two three four five six", 3, "z")], "item_id long, text string, doc_id int, shared string")
    docs = spark.createDataFrame([(9, "zero one two three four five six seven", 1, "z")], "doc_id long, text string, item_id int, shared string")
    assert [(r.doc_id, r.item_id) for r in decontam.search(docs, items).collect()] == [(9, 1)]


def test_texts_longer_than_a_slice(spark):
    long = " ".join(f"word{k}" for k in range(700_000))  # more than SLICE_BYTES
    assert len(long) > common.SLICE_BYTES
    table = spark.createDataFrame([(1, long), (2, "short text of a few words"), (3, long + " more")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.class_id for r in neardup.classes(table, common.shared_dir(spark)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    assert quality.score(table, quality.Machine(0.0, np.zeros(quality.FEATURES, np.float32), np.zeros((quality.FEATURES, 1), np.float32))).count() == 3
