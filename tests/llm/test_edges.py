"""Empty tables and clashing names, and what the stages of the pipeline decide, against plain Python."""

import pytest

import corpus_pipeline as pipeline
from carrierlab.llm import backoff, chat, language, quality
from tests.llm.test_operators import brute_components, corpus, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_empty_tables(spark, labelled):
    docs = spark.createDataFrame([], DOCS)
    grades = quality.graded(spark.read.parquet(f"{labelled}/labels.parquet"))
    assert quality.classify(docs, quality.train(docs, grades)).count() == 0
    assert chat.read_back(chat.windows(spark.createDataFrame(
        [], "conv_id long, turn long, role string, text string"))).count() == 0
    assert language.pages_language(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, labelled).count() == 0


def test_clashing_names(spark, labelled):
    rows = [(1, "some text of one", "en", "s", 9, 1.0, 2, False, "x"), (2, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS + ", score double, tail int, kept boolean, expected_grade string")
    grades = quality.graded(spark.read.parquet(f"{labelled}/labels.parquet"))
    got = quality.classify(docs, quality.train(docs, grades))
    assert got.columns == ["doc_id", "score", "expected_grade", "tail", "kept"] and got.count() == 2
    pages = spark.createDataFrame(
        [(1, "http://a.de/x", "<html lang='de'>der und die</html>", "x", 1)] * 2, "page_id long, url string, html string, predicted string, kept int")
    assert language.pages_language(pages).count() == 2


def test_stages_on_planted_copies(spark, labelled):
    """Line dedup and near duplicates keep exactly what a plain programme keeps."""
    rows = [(i, t) for i, t in dict(corpus()).items() if i is not None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    component = brute_components(sets)
    kept = pipeline.near_duplicates(spark, docs, labelled)
    assert kept.columns == pipeline.COLUMNS
    assert {r.doc_id for r in kept.collect()} == {i for i in sets if component[i] == i}

    earlier, want = [], {}
    for i, t in sorted((x for x in rows if x[1] is not None)):
        lines = []
        for text in t.split("\n"):
            w = frozenset(words(text))
            if not (w and any(100 * len(w & e) >= 85 * len(w | e) for e in earlier)):
                lines.append(text)
            if w:
                earlier.append(w)
        want[i] = "\n".join(lines)
    had = {i for i, t in rows if words(t)}
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.lines(spark, docs, labelled).collect()}
    left = {i: t for i, t in want.items() if words(t) or i not in had}
    assert {i: x[0] for i, x in got.items() if x[0] is not None} == left
    assert all(n == len(t) for t, n in got.values() if t is not None)


def test_backoff_scores_without_any_word(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (None, " \n")], "doc_id long, text string")
    got = backoff.backoff_scores(docs).collect()
    assert len(got) == 3 and {(r.n_words, r.log_score) for r in got} == {(0, 0.0)}
