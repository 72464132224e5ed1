"""Classifiers by held-out accuracy, nearest neighbours by recall, page layout by fixtures, and the pipeline by its stages."""

import re
import time
import zlib

import corpus_pipeline
import numpy as np
import pytest
from helpers import ODD_TEXTS, none, odd
from pyspark.sql import functions as F

from shardloom.llm import boosting, byte_bpe, html_layout, labelled, multi_index, order_minhash, quality, queries, toxicity, wu_manber

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


# --- boosting --------------------------------------------------------------------------------------------------------


def test_trees_and_additive_model_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.AdditiveModel(rounds=20).fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert (0, 1) in model.pair_tables
    trees = boosting.Trees(trees=60).fit(x[:2000], y[:2000])
    assert ((trees.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.9


def test_additive_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    model = quality.AdditiveModel(rounds=10).fit(x, (x[:, 2] + x[:, 0] > 0).astype(float))
    row = x[7]
    total = model.base + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.tables, model.edges, row))
    for (f, e), t in model.pair_tables.items():
        total += t[np.searchsorted(model.coarse[f], row[f], side="right"), np.searchsorted(model.coarse[e], row[e], side="right")]
    assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_isotonic_rises_and_pools():
    level = boosting.Isotonic().fit(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 1, 1]))
    assert level(np.array([0.0, 1, 2, 2.5, 3, 4, 9])).tolist() == [0, 0, 0.5, 0.5, 0.5, 1, 1]


# --- classifiers -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name, label, least", [("op2_quality", "quality", 0.95), ("op7_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r[label] for r in rows]) >= least
    assert got.count() == 1000 and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_held_out_rows_are_never_learned_from(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id"), labelled.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    sample = labelled.labelled_texts(docs, labels, "quality")
    assert sample.count() == sum(not r["h"] for r in rows)
    assert labelled.labelled_texts(docs, labels, "quality", limit=7).count() == 7


def test_the_sample_counts_texts_that_are_there_once(spark):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5]
    there = ids[-20:]
    rows = [(k, f"text {k}") for k in there] + [(there[0], f"text {there[0]}")] * 100 + [(there[1], None), (there[1], ""), (there[1], "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id bigint, quality int")
    got = sorted(((r["text"] is None, r["text"] or "", r["y"]) for r in labelled.labelled_texts(docs, labels, "quality", limit=22).collect()))
    want = [(False, f"text {k}", k % 2) for k in there] + [(False, "", there[1] % 2), (True, "", there[1] % 2)]
    assert got == sorted(want)  # neither the 300 ids without a document nor the copies use up the limit
    assert labelled.labelled_texts(docs, labels, "quality", limit=21).count() == 21


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_of_odd_rows(spark, module):
    label = "quality" if module is quality else "toxic"
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (2, 0), (3, 0), (5, 1), (6, 0), (7, None), (8, 1), (8, 0), (None, 1)], f"doc_id bigint, {label} int")
    for docs, marks in ((odd(spark), labels), (odd(spark), labels.limit(0)), (none(spark), labels)):
        scored = module.score(docs, module.fit(docs, marks))
        assert sorted(scored.columns) == sorted(["doc_id", "text", "score", "ids", "lang"])
        rows = scored.collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 1}) <= 1
    model = module.fit(odd(spark), labels)
    keep = quality.keep_good if module is quality else toxicity.keep_clean
    assert keep(odd(spark), model).columns == ["doc_id", "text", "score", "ids", "lang"]


def test_toxicity_features_see_what_they_name():
    lexicon = toxicity.Lexicon({"=grubl": 5.0, "4zark": 4.0})
    at = {n: k for k, n in enumerate(toxicity.NAMES)}

    def see(text):
        return lexicon.text_features(text.encode())

    assert see("")[at["hits"]] == 0
    row = see("you are a grubl, ZARKOM and 1d1ot !!")
    assert (row[at["hits"]], row[at["begun"]], row[at["distinct_hits"]]) == (2, 1, 2)
    assert row[at["near_you"]] == 2 and row[at["hidden_hits"]] == 1 and row[at["capital_hits"]] == 1
    assert see("grubl a b c d e f g h i you")[at["near_you"]] == 0
    assert see("st*pid idi0t")[at["hidden"]] == 1.0


# --- nearest neighbours ----------------------------------------------------------------------------------------------


def _exact(vectors, asked, k):
    out = {}
    for q in asked:
        away = multi_index.distances(vectors[q], np.array(list(vectors.values())))
        pairs = sorted((a, i) for a, i in zip(away, vectors) if i != q)[:k]
        out[q] = [(i, a) for a, i in pairs]
    return out


def test_op5_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    want = _exact(vectors, [i for i in vectors if i % 100 == 0], 10)
    got = {}
    for r in sorted(queries.op5_multi_index(spark, SMALL).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["score"] == pytest.approx(multi_index.distances(vectors[r["query_id"]], vectors[r["vec_id"]][None])[0], abs=1e-12)
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 16, (400, 8), dtype=np.uint16)
    codes[50:80] = codes[0] ^ (1 << rng.integers(0, 16, (30, 8))).astype(np.uint16)
    indexes = multi_index.SubstringIndexes(codes)
    for radius in (0, 3, 7, 8, 9, 40, 55, 128):
        near = np.flatnonzero(multi_index._POPCOUNT[codes ^ codes[0]].sum(axis=1) <= radius)
        assert indexes.within(codes[0], radius).tolist() == near.tolist()


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "q"), (100, [0.0, 2.0], "q"), (1, [1.0, 0.1], None), (2, [1.0, 0.1], "x"), (3, [0.0, 0.0], "x"), (4, None, "x"),
            (5, [nan, 1.0], "x"), (6, [inf, 1.0], "x"), (7, [None, 1.0], "x"), (8, [1.0], "x"), (9, [], "x"), (None, [1.0, 1.0], "x"),
            (2, [1.0, 0.1], "x"), (200, [0.0, 0.0], "q"), (0, [1.0, 0.0], "q")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank string")
    got = multi_index.search(table, F.col("vec_id") % 100 == 0, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (100, 1, 1), (100, 2, 2), (100, 3, 2)]
    assert got[0]["score"] == pytest.approx(0.1)
    assert multi_index.search(table.limit(0), F.col("vec_id") % 100 == 0, 3).count() == 0
    assert multi_index.search(table, F.col("vec_id") == 77, 3).count() == 0
    assert multi_index.search(table.where("vec_id IN (0, 1)"), F.col("vec_id") % 100 == 0, 3).count() == 1


# --- pages -----------------------------------------------------------------------------------------------------------

PAGES = [
    ("<p>one <b>two</b>\n three<p>four<br>five", "one two three\n\nfour\nfive"),
    ("<ul><li>a<li>b<ul><li>b1<li>b2</ul><li>c</ul><ol start=3><li>x<li value=9>y</ol>", "- a\n- b\n  - b1\n  - b2\n- c\n\n3. x\n9. y"),
    ("<table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>Apple<td>10<tr><td rowspan=2>r<td>1<tr><td>2</table>after",
     "Cap\nName   Qty\nApple  10\nr      1\n       2\n\nafter"),
    ("<table><tr><td>a<td colspan=2>wide wide<td>z<tr><td>b<td>1<td>2<td>y</table>", "a  wide wide  z\nb  1  2  y"),
    ("<pre>  a\n   b  c</pre>d", "  a\n   b  c\n\nd"),
    ("<head><title>t</title><style>x</style></head><body>a<script>var t='</p>';</script><!-- c -->b<noscript>n</noscript>", "ab"),
    ("<div hidden>a</div><p style='color:red; display : none'>b</p><span style='visibility:hidden'>c</span><i>d</i>", "d"),
    ("<details><summary>S</summary>no</details><select><option>p<option selected>q</select><input type=hidden value=h><input type=submit value=Go>", "S\nq\nGo"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl><blockquote>q</blockquote>x&nbsp;y &copy; &lt;z", "t\n  d\nu\n  e\n\n  q\n\nx y © <z"),
    ("<nav>menu</nav><footer>end</footer>", "menu\nend"),
    ("a < b & c</p></b></div>d", "a < b & c\n\nd"),
    ("", ""), (None, ""), ("<", "<"), ("plain", "plain"),
]


def test_page_layouts(spark):
    pages = spark.createDataFrame([(k, h, "old") for k, (h, _) in enumerate(PAGES)], "page_id bigint, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_layout.extract_text(pages).collect()}
    for k, (html, text) in enumerate(PAGES):
        assert got[k] == text, html
    assert html_layout.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page, text", [("<div>" * 3000 + "deep", "deep"), ("<ul>" * 500 + "<li>q", "q"), ("<table>" * 300 + "t", "t"),
                                        ("<b>" * 5000 + "k", "k"), ("<div>" * 400 + "<script>no</script>yes", "yes"),
                                        ("<div>" * 400 + "<div hidden><div>no</div></div>yes", "yes"), ("w " * 90_000, ("w " * 90_000).strip())])
def test_deep_and_long_pages(page, text):
    assert html_layout.visible_text(page) == text


def test_op3_keeps_every_visible_word(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = queries.op3_html_layout(spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        seen = re.sub(r"(?s)<(script|style|title)[^>]*>.*?</\1>|<!--.*?-->", "", pages[r["page_id"]])
        words = re.sub(r"<[^>]*>", " ", seen)
        import html as entities

        assert [w for w in r["text"].split() if w != "-"] == [w for w in entities.unescape(words).split() if w != "-"]


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_equals_its_operators(spark):
    """Each stage is held against the operator's own scores and classes on the rows that reached it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    left = docs
    for (name, stage), expected in zip(corpus_pipeline.STAGES, (
        lambda d: {r["doc_id"] for r in quality.score(d, quality.fit(d, labels)).collect() if r["score"] >= 0.3},
        lambda d: {r["doc_id"] for r in toxicity.score(d, toxicity.fit(d, labels)).collect() if r["score"] < 0.5},
        lambda d: {r["class_id"] for r in order_minhash.classes(d).collect()},
        lambda d: {r["doc_id"] for r in wu_manber.report(wu_manber.find_items(d, benchmark)).collect() if not r["contaminated"]},
        None,
    )):
        out = stage(spark, left, SMALL)
        if expected is None:
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, byte_bpe.round_trip(left).collect()))
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))
        else:
            assert out.columns == docs.columns
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == expected(left) and len(rows) == len({r["doc_id"] for r in rows}), name
            left = spark.createDataFrame(rows, docs.schema)


def test_pipeline_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, *_ in ODD_TEXTS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for empty in (False, True):
        left = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, SMALL)
            assert left.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, left, SMALL).count() == left.count()


@pytest.mark.parametrize("page", [
    "<a " * 333_000, '<a b="' * 170_000, "<a b='" * 170_000 + "'>", "<!--" * 250_000, "</" * 300_000, "<" * 500_000, "<script>" * 100_000,
    "<!" * 300_000, "<table><tr>" + "<td>x" * 20_000 + "</table>", '<div style="visibility:hidden">' * 20_000, "<p " * 200_000 + ">",
    "<div hidden>" * 20_000 + "</p>" * 20_000,
], ids=range(12))
def test_broken_pages_cost_no_more_than_their_length(page):
    begin = time.process_time()
    html_layout.visible_text(page)
    assert time.process_time() - begin < 4


def test_numbers_spans_and_visibility():
    page = html_layout.visible_text
    assert page("<ol start=1234567><li>a<li value='0000000000000000000008'>b</ol>") == "1234567. a\n8. b"
    assert page("<ol start=99999999999999><li>a</ol>") == "1. a"
    hidden = '<div style="visibility:hidden">no <b style="color:red; visibility: visible">yes <i style="visibility:hidden">no</i></b> no<ul><li>no</ul></div>'
    assert page(hidden + "<p>end") == "yes\n\nend"
    assert page('<table style="visibility:collapse"><tr><td>no<td style="visibility:visible">yes</table>') == "  yes"
    assert page('<p style="visibility:hidden">no</p><p style="display:none"><b style="visibility:visible">no</b></p>') == ""
    assert page("<style>p { display: none }</style><p>shown") == "shown"


def test_tags_that_never_end_are_no_text():
    page = html_layout.visible_text
    assert page("before <b") == "before" and page('before <b title="x > y') == "before" and page("a <!-- b") == "a"
    assert page("1 < 2 & 3 > 2 &amp; a&lt;b <3 </ x> y") == "1 < 2 & 3 > 2 & a<b <3 y"
    assert page("<!-->a<!--->b<!-- x --!>c<!x>d<?y>e") == "abcde"
    assert page("<textarea>a &amp; <b>b</b></textarea><script>if (a </b) x</script>c") == "a & <b>b</b>c"
    assert page("<a =x y=1 / z>l</A\n>m<br/>n") == "lm\nn"
