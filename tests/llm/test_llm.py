"""Corpus operators against brute force, round trips and held-out labels, and on rows of every odd kind."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from factorloom.llm import boosting, common, decontam, html_extract, langid, neardup, packing, quality, token_counts, tokens, topk, toxicity, warc, words

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "!!! ###"), (5, "one"), (5, "one"), (None, "a null id"), (6, "ein zwei drei vier fünf sechs " * 400), (7, "<|endoftext|> İ don't x²y 日本語")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, node long, runs string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every odd kind, with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.0, "x", 1, "y") for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, DATA, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return common.table(spark, DATA, "labels")


def test_encoder_equals_the_tokenizer():
    e = tokens.Encoder(tokens.vocabulary_path())
    texts = [t or "" for _, t in ODD] + ["don't WE'LL 12ab_c café́ ΑΣ \tb\x85c", "́ abc …"]
    got = e.encode(pa.array(texts, pa.large_string()))
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [got.values[a:b].tolist() for a, b in zip(got.offsets, got.offsets[1:])] == want


def test_shingles_are_runs_of_words():
    texts = ["a b c d e f", "x y", "", "a b c d e"]
    s = words.shingles(words.hashed_words(pa.array(texts, pa.large_string())))
    assert s.lengths().tolist() == [2, 1, 0, 1] and s.values[0] == s.values[-1]


def test_packing_holds_every_id_once(spark, docs, odd, empty):
    assert packing.pack_documents(empty).count() == 0
    e = tokens.Encoder(tokens.vocabulary_path())
    for df, n in ((docs, docs.count()), (odd, len(ODD))):
        got = packing.pack_documents(df).toPandas()
        text = {r.doc_id: r.text or "" for r in df.collect()}
        assert got.groupby(["sequence_id"]).length.sum().map(lambda k: k == 4096 or k & (k - 1) == 0).all()
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert (s.offset.to_numpy() == s.length.cumsum().shift(fill_value=0).to_numpy()).all()
        for i, own in got.dropna(subset="doc_id").drop_duplicates(["doc_id", "start"]).groupby("doc_id"):
            ids = np.array([*e.tokenizer.encode(text[i], add_special_tokens=False).ids, 2], "<u4")
            assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
            assert all(zlib.crc32(ids[a : a + k].tobytes()) == c for a, k, c in zip(own.start, own.length, own.ids_crc32))
        assert (got.start == 0).sum() == n


def test_packing_keeps_limits_of_instruction_data(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(n), int(n // 3)) for i, n in enumerate(rng.integers(1, 900, 300))]
    lim = packing.Limits(tokens=1000, segments=4, loss=300)
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long"), lim).toPandas()
    by = got.groupby("sequence_id")
    assert by.length.sum().max() <= 1000 and by.size().max() <= 4 and by.loss_tokens.sum().max() <= 300 and len(got) == 300


@pytest.mark.parametrize("block", [2, 10, 64, 4_000_000])
def test_token_counts_stitch_blocks(spark, odd, empty, block):
    e = tokens.Encoder(tokens.vocabulary_path())
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(odd, common.shared_dir(spark), block_bytes=block).collect())
    want = sorted((str(i), len(e.tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert got == want
    assert token_counts.count_tokens(empty, common.shared_dir(spark)).count() == 0


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, []), (None, [1.0] * 6), (50, [0.1] * 6), (904, [2.0, 1.0])]
    df = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), common.shared_dir(spark), shard_rows=40, block_queries=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    table = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    for q, best in got.items():
        query = min((tuple(v) for i, v in table if i == q))
        want = sorted((-int(v @ np.array(query)), i) for i, v in table if i != q)[:5]
        assert [(-s, i) for _, i, s in sorted(best)] == want
    assert len(got) == 6
    assert topk.top_k(df.limit(0), df.limit(0), common.shared_dir(spark)).count() == 0


def test_containment_matches_brute_force(spark, docs, odd, empty):
    items = common.table(spark, DATA, "benchmark")
    got = {(r.doc_id, r.item_id, r.shared) for r in decontam.search(docs, items).collect()}
    bench = [(r.item_id, decontam.runs_of(r.text)) for r in items.collect()]
    want = set()
    for r in docs.collect():
        own = decontam.runs_of(r.text)
        want |= {(r.doc_id, i, len(own & s)) for i, s in bench if len(own & s) >= 0.8 * len(s) - 1e-9}
    assert got == want and want
    assert got == {(r.doc_id, r.item_id, r.shared) for r in decontam.search(docs, items, block_bytes=2_000).collect()}
    few = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "a null id"), (4, "absent words")], "item_id long, text string")
    assert sorted(str((r.doc_id, r.item_id)) for r in decontam.search(odd, few).collect()) == sorted(map(str, [(5, 3), (5, 3), (None, None)]))
    assert decontam.search(empty, few).count() == 0 and decontam.keep_clean(odd, few).count() == len(ODD) - 3


def classes_by_force(rows, threshold=0.8):
    texts = [(i, t or "") for i, t in rows]
    runs = [decontam.runs_of(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            same = texts[a][1] and texts[a][1] == texts[b][1]
            both = len(runs[a] & runs[b])
            if same or both and both / (len(runs[a]) + len(runs[b]) - both) >= threshold:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), str(least.get(find(k)))) for k, (i, _) in enumerate(texts))


def test_near_copies_match_brute_force(spark, docs, odd, empty):
    got = neardup.classes(docs, common.shared_dir(spark)).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == classes_by_force([(r.doc_id, r.text) for r in docs.collect()])
    got = neardup.classes(odd, common.shared_dir(spark)).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == classes_by_force(ODD)
    assert neardup.classes(empty, common.shared_dir(spark)).count() == 0
    kept = neardup.keep_one(odd, common.shared_dir(spark))
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1 and kept.count() == len(ODD) - 1


def test_probability_similarity_is_the_formula():
    rng = np.random.default_rng(2)
    a, b = np.unique(rng.integers(0, 60, 40)).astype("<u4"), np.unique(rng.integers(0, 60, 40)).astype("<u4")
    wa, wb = rng.integers(1, 4, len(a)).astype(np.float32), rng.integers(1, 4, len(b)).astype(np.float32)
    x, y = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
    want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
    assert neardup.similarity(a, wa, b, wb)[1] == pytest.approx(want)


def test_registers_agree_as_often_as_the_similarity():
    m, n = 4096, 60
    rng = np.random.default_rng(3)
    run = words.mix(np.arange(n, dtype=np.uint64))
    w = rng.integers(1, 4, n).astype(float)
    left, right = np.arange(0, 50), np.arange(10, 60)
    row = np.repeat([0, 1], [50, 50])
    regs = neardup.registers(row, np.concatenate([run[left], run[right]]), np.concatenate([w[left], w[right]]), 2, m)
    a, b = np.arange(0, 50).astype("<u4"), np.arange(10, 60).astype("<u4")
    want = neardup.similarity(a, w[left].astype(np.float32), b, w[right].astype(np.float32))[1]
    assert (regs[0] == regs[1]).mean() == pytest.approx(want, abs=0.04)


def ranks(y, s):
    order = np.argsort(np.argsort(s, kind="stable"))
    return (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_scores_are_defined_and_learn(spark, docs, labels, odd, empty):
    bigger = common.table(spark, "/root/testdata/sf0.01", "documents")
    known = common.table(spark, "/root/testdata/sf0.01", "labels")
    machine = quality.train(bigger, known)
    got = quality.score(bigger, machine).where("held_out").join(known, "doc_id").toPandas()
    assert ranks(got.quality.to_numpy(), got.score.to_numpy()) > 0.95
    model = toxicity.train(bigger, known, common.shared_dir(spark))
    got = toxicity.score(bigger, model).where("held_out").join(known, "doc_id").toPandas()
    assert ranks(got.toxic.to_numpy(), got.score.to_numpy()) > 0.7 and got.predicted[got.toxic == 0].mean() < 0.05
    found = toxicity.passages(bigger, model).limit(1).collect()
    assert found and found[0].p_value < 0.01
    none = labels.limit(0)
    for scored in (quality.score(odd, machine), toxicity.score(odd, model), quality.score(odd, quality.train(odd, none)), toxicity.score(odd, toxicity.train(odd, none, common.shared_dir(spark)))):
        rows = scored.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert quality.score(empty, machine).count() == 0 and toxicity.score(empty, model).count() == 0
    assert quality.keep_good(odd, machine).columns == odd.columns


def test_machine_pairs_by_the_identity():
    rng = np.random.default_rng(4)
    v, w, x = rng.normal(size=(6, 3)).astype(np.float32), rng.normal(size=6).astype(np.float32), rng.normal(size=6).astype(np.float32)
    got = quality.Machine(0.5, w, v).raw(1, np.zeros(6, int), np.arange(6), x)[0]
    want = 0.5 + w @ x + sum(v[i] @ v[j] * x[i] * x[j] for i in range(6) for j in range(i))
    assert got == pytest.approx(want, abs=1e-4)


def test_segments_are_all_maximal():
    rng = np.random.default_rng(5)
    for _ in range(50):
        dense = np.where(rng.random(30) < 0.4, rng.integers(1, 4, 30), -1).astype(float)
        at = np.flatnonzero(dense > 0)
        got = [(a, b) for a, b, _ in toxicity.segments(at, dense[at], drift=1.0)]

        def force(a, b):
            if a >= b or dense[a:b].max() <= 0:
                return []
            best = max(((dense[i:j].sum(), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), key=lambda r: (r[0], r[1], -r[2]))
            return [*force(a, best[2]), (best[2], best[3]), *force(best[3], b)]

        total = lambda s: sorted(round(dense[a:b].sum(), 6) for a, b in s)
        assert max(total(got)) == max(total(force(0, 30))) and all(b <= c for (_, b), (c, _) in zip(got, got[1:]))
        assert all(dense[a:b].sum() > 0 for a, b in got)


def test_language_of_held_out_documents(spark, odd, empty):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs, langid.train(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.rejected.mean() < 0.05 and got.score.between(0, 1).all()
    model = langid.train(docs)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and rows[6].lang_pred == "de" and rows[1].rejected
    assert langid.identify(empty, model).count() == 0 and langid.identify(odd, langid.train(empty)).where("lang_pred = 'und'").count() == len(ODD)
    assert langid.keep_identified(odd, model).columns == odd.columns


def test_main_text_of_pages(spark):
    model = html_extract.train(200)
    pages = ["", "<p>alone", "plain text only", "<html><body><nav><ul><li><a href='/a'>menu</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First   line<br>second.<p>Third <b>bo</b>ld.</article><footer>&copy; foot</footer>", "<div class='x", "<!-- open"]
    got = html_extract.main_text(model, pages)
    assert got[0] == "" and got[3] == "Title & more First line second. Third bold." and got[5] == ""
    table = spark.createDataFrame([(1, None, None), (2, "u", pages[3]), (2, "u", pages[3])], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    rows = html_extract.extract(table, model).collect()
    assert sorted(r.n_chars for r in rows) == [0, len(got[3]), len(got[3])]
    assert html_extract.extract(table.limit(0), model).count() == 0


def test_decoding_never_keeps_a_child_of_a_dropped_parent():
    nodes = html_extract.listed(html_extract.parse("<div id=a><div id=b><p id=c>x</p></div><p id=d>y</p></div>"))
    rng = np.random.default_rng(6)
    for _ in range(50):
        odds = rng.normal(size=len(nodes))
        keep = html_extract.decode(nodes, odds)
        assert all(keep[v.parent.index] or not keep[v.index] for v in nodes[1:])
        best = max((sum(o for o, k in zip(odds[1:], bits) if k), bits) for bits in np.ndindex(*[2] * (len(nodes) - 1)) if all(not bits[v.index - 1] or v.parent.index == 0 or bits[v.parent.index - 1] for v in nodes[1:]))[0]
        assert odds[1:][keep[1:]].sum() == pytest.approx(best)


def test_boosting_learns():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((boosting.fit(x[:300], y[:300]).log_odds(x[300:]) > 0) == y[300:]).mean() > 0.9


def test_archives_round_trip(spark):
    long = "<p>" + "wörd " * 40
    rows = [(5, "http://a/", long), (3, "http://b/", long), (9, None, long), (None, "http://n/", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", long + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload_digest", "1 as salt")
    folder = common.shared_dir(spark)
    got = {r.page_id: r for r in warc.round_trip(pages, folder).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), None: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None)}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha256(raw).hexdigest()
    whole = warc.with_originals(warc.read_archives(spark, warc.write_archives(pages, common.shared_dir(spark)), payloads=True)).collect()
    assert all(bytes(r.payload) == dict((i, (h or "").encode()) for i, _, h in rows)[r.page_id] for r in whole)
    assert warc.round_trip(pages.limit(0), common.shared_dir(spark)).count() == 0


def test_pipeline_matches_its_stages(spark):
    import corpus_pipeline

    docs = common.table(spark, DATA, "documents")
    labels, items = common.table(spark, DATA, "labels"), common.table(spark, DATA, "benchmark")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in langid.identify(docs, langid.train(docs)).where("not rejected").collect()}
    now = common.written(docs.where(docs.doc_id.isin(list(kept))), common.shared_dir(spark))
    good = {r.doc_id for r in quality.score(now, quality.train(now, labels)).where("predicted = 1").collect()}
    one = {int(c) for _, c in classes_by_force([(i, rows[i].text) for i in sorted(good)])}
    bench = [decontam.runs_of(r.text) for r in items.collect()]
    clean = {i for i in one if all(len(decontam.runs_of(rows[i].text) & b) < 0.8 * len(b) - 1e-9 for b in bench)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == clean and 0 < len(clean) < len(rows)
