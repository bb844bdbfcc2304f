"""Cases in which the corpus operators once did less than the whole job."""

from __future__ import annotations

import numpy as np
import pytest

from factorloom.llm import common, html_extract, neardup, token_counts, tokens


@pytest.fixture(scope="module")
def model():
    return html_extract.train(html_extract.TRAINING_PAGES)


def words_of(k, n=60):
    return " ".join(f"{w}{k}" for w in ["river", "stone", "cloud", "market", "seven", "paper"] * (n // 6)) + "."


def test_bare_text_of_the_body_is_kept(model):
    page = f"<body><h1>Title</h1>{words_of(1)}<br><br>{words_of(2)} <b>bold</b> end<p>last {words_of(3)}</p></body>"
    assert html_extract.main_text(model, [page]) == [f"Title {words_of(1)} {words_of(2)} bold end last {words_of(3)}"]


def test_bare_text_of_the_body_is_decided_run_by_run():
    nodes = html_extract.listed(html_extract.parse("one<p>two</p> <p>three</p>four<br>five <i>six</i>"))
    assert [v.tag for v in nodes] == ["html", "#text", "p", "p", "#text"]
    keep = np.array([True, False, True, False, True])
    assert html_extract.joined(nodes, keep) == "two four five six"
    assert html_extract.joined(nodes, np.array([True] + [False] * 4)) == "one four five six"


def test_siblings_beyond_64_count_in_features():
    nodes = html_extract.listed(html_extract.parse("<div>" + "<p>x</p>" * 80 + "<h2>heading</h2><p>" + "long " * 50 + "</p></div>"))
    x = html_extract.features(nodes)
    assert x[2:, 15].tolist() == list(range(82))  # position
    assert x[2:, 17] == pytest.approx([81 / 82] * 80 + [1 / 82, 81 / 82])  # share of equal tags
    assert x[2:, 23] == pytest.approx(np.log1p(250))  # the largest text
    assert x[81, 19] == html_extract.TAG_NUMBER["h2"] and x[2, 18] == -1


def test_plain_copies_share_a_band_whatever_their_counts(spark):
    """Pairs of plain similarity 0.8 or more, whose lines are repeated differently."""
    rows, rng = [], np.random.default_rng(5)
    for k in range(60):
        w = [f"w{k}x{i}" for i in range(120)]
        line, other = " ".join(w[:24]), [*w[:112], *(f"v{k}x{i}" for i in range(4))]
        rows.append((2 * k, f"{' '.join(w)} {' '.join([line] * 100)}"))
        rows.append((2 * k + 1, f"{' '.join(w)} {line} {line}" if k % 2 else f"{' '.join(other)} {' '.join([line] * int(rng.integers(2, 4)))}"))
    got = neardup.sketch(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = {r.doc_id: (np.frombuffer(r.runs, "<u4"), np.frombuffer(r.weights, "<f4") if r.weights else np.ones(len(r.runs) // 4, np.float32), set(r.bands)) for r in got}
    for k in range(60):
        (a, wa, x), (b, wb, y) = near[2 * k], near[2 * k + 1]
        plain, prob = neardup.similarity(a, wa, b, wb)
        assert plain >= 0.8 > prob
        assert x & y


def test_texts_without_repeats_have_no_second_bands(spark):
    once = " ".join(f"w{i}" for i in range(50))
    got = {r.doc_id: r.bands for r in neardup.sketch(spark.createDataFrame([(1, once), (2, f"{once} {once}")], "doc_id long, text string")).collect()}
    assert len(got[1]) == neardup.BANDS < len(got[2]) <= 2 * neardup.BANDS


@pytest.mark.parametrize("block", [6, 4_000_000])
def test_token_counts_of_texts_that_spell_out_the_end_token(spark, block):
    texts = ["one", "two <|endoftext|> three", "<|endoftext|>", "four five six seven", "<|endoftext|><|endoftext|> x", "last of all"]
    e = tokens.Encoder(tokens.vocabulary_path())
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table, common.shared_dir(spark), block_bytes=block).collect()}
    assert got == {i: len(e.tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_token_files_reject_an_end_id_that_a_text_gives(spark):
    table = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    with pytest.raises(Exception, match="closes documents"):
        token_counts.count_tokens(table, common.shared_dir(spark), end_id=49407).collect()


def test_one_row_of_each_class_stays_whatever_its_ids(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white grey", "sun moon star sky sea land")
    rows = [(1, a), (2, a), (2, b), (3, b), (None, b), (None, c), (None, c), (None, d), (5, d), (2, "its own text"), (7, None), (None, None), (None, "")]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), common.shared_dir(spark))
    want = [(1, a), (2, b), (None, c), (5, d), (2, "its own text"), (7, None), (None, None), (None, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
