"""Every operator and every stage on rows with NULLs, empty and long texts, ties, repeats, clashing names, and no rows."""

import hashlib

import pytest

import corpus_pipeline
from tabloom.llm import (
    edit_embedding,
    languages,
    mixing,
    near_copies,
    personal_data,
    perspectives,
    posting_lists,
    sentencepiece_backend,
    simhash,
    suffix_arrays,
    toxicity,
)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, 0, None), (None, 0, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("run", [
    simhash.simhash_components, edit_embedding.edited_documents, sentencepiece_backend.encode_decode,
    languages.language_documents, personal_data.private_documents, mixing.mix_documents, suffix_arrays.remove_repeats,
], ids=lambda f: f.__name__)
def test_one_row_for_each_document(run, odd_docs, no_docs):
    assert sorted(r.doc_id or -1 for r in run(odd_docs).collect()) == sorted(r.doc_id or -1 for r in odd_docs.collect())
    assert run(no_docs).collect() == []


def test_toxicity_of_odd_rows(odd_docs, no_docs, labels):
    scores = toxicity.toxic_documents(odd_docs, labels).collect()
    assert len(scores) == odd_docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.toxic_documents(no_docs, labels).count() == 0
    # nothing to learn from: nothing is called toxic
    assert {r.predicted for r in toxicity.toxic_documents(odd_docs, labels.limit(0)).collect()} == {0}


def test_defined_results(odd_docs):
    rows = {r.doc_id: r for r in suffix_arrays.remove_repeats(odd_docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (rows[5].n_removed, rows[5].n_spans, rows[5].kept_sha256) == (rows[5].n_bytes, 1, empty)
    assert (rows[4].n_bytes, rows[4].n_removed, rows[4].kept_sha256) == (0, 0, empty)
    assert rows[9].n_removed == rows[9].n_bytes == 1400  # overlapping copies within one document count
    found = {r.doc_id: r for r in languages.language_documents(odd_docs).collect()}
    assert found[3].lang_pred == found[4].lang_pred == found[7].lang_pred == "und" and found[3].score == 0
    prints = {r.doc_id: r for r in simhash.simhash_components(odd_docs).collect()}
    assert prints[3].fingerprint == prints[4].fingerprint == prints[7].fingerprint == "0" * 16
    assert prints[7].component_id == 3 and prints[6].component_id == 5
    phones = {r.doc_id: r for r in personal_data.private_documents(odd_docs).collect()}
    assert phones[8].n_phone == 1 and phones[4].spans == ""
    tokens = {r.doc_id: r for r in sentencepiece_backend.encode_decode(odd_docs).collect()}
    assert tokens[4].n_tokens == tokens[3].n_tokens == 0 and all(r.parity and r.round_trip for r in tokens.values())
    taken = {r.doc_id: r for r in mixing.mix_documents(odd_docs).collect()}
    assert taken[4].size == taken[4].taken == 0


def test_stages(spark, odd_docs, no_docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, none = odd_docs, no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs, none = stage(spark, docs, str(tmp_path)), stage(spark, none, str(tmp_path))
        assert none.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == odd_docs.columns and docs.dtypes == odd_docs.dtypes, name
    assert docs.count() > 0


def test_one_of_each_group_stays(odd_docs):
    kept = near_copies.drop_near_copies(odd_docs).collect()
    # 1 and its repeat and 2; 5 and 6; the empty, blank and NULL texts (3, 4, 7 and the one without an id)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [
        (False, 1), (False, 3), (False, 5), (False, 8), (False, 9), (True, 0)]


def test_masking(spark):
    docs = spark.createDataFrame(
        [(1, "write to jo.doe@mail.example.com or call +1 (042) 555-7845 now", "en", "s", 1), (2, None, "en", "s", None)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = {r.doc_id: r for r in corpus_pipeline.mask_personal(spark, docs, "").collect()}
    assert rows[1].text == "write to <EMAIL> or call <PHONE> now" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[2].n_chars is None


def test_odd_vectors(spark):
    rows = [
        (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]),
        (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (8, [0.0, 2.0]), (9, [1.0, 2.0, 3.0]),
        (200, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "vec_id as list", "1 as q")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in posting_lists.neighbour_documents(vectors).orderBy(
        "query_id", "rank").collect()]
    assert got == [(100, 1, 1, 0.0), (100, 2, 2, 0.0), (100, 3, 8, 5**0.5)]
    assert posting_lists.neighbour_documents(vectors.limit(0)).count() == 0


def test_odd_conversations(spark):
    rows = [
        (1, 1, "user", "hi"), (1, 2, "bob", "<|end|>"), (1, None, None, None), (1, 2, "bob", "<|end|>"), (1, 0, "system", "be kind"),
        (None, 0, "ann", "x"), (2, 0, "system", "alone"), (3, 0, "", ""), (4, 70, "ann", "b"), (4, 0, "ann", "a")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "turn as segment", "role as perspective")
    out = perspectives.rotate_perspectives(turns).collect()
    assert sorted({(r.conv_id or -1, r.perspective) for r in out}) == [
        (-1, "ann"), (1, "bob"), (1, "unknown"), (1, "user"), (3, "unknown"), (4, "ann")]
    for r in out:
        spans = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",") if s]
        assert len(r.rendered) == r.n_chars and sum(b - a for a, b in spans) == r.n_masked_in
        for a, b in spans:
            assert r.rendered[:a].endswith("<|assistant|>\n") and r.rendered[a:b].endswith("<|end|>")
        assert r.rendered.count("<|end|>") == r.n_turns
    four = sorted((r for r in out if r.conv_id == 4), key=lambda r: r.segment)
    assert [r.start_char for r in four] == [0, four[0].n_chars]
    assert perspectives.rotate_perspectives(turns.limit(0)).count() == 0


def test_words_end_at_ascii_space_only(spark):
    """Line separators of Unicode are words of their own, also at the end of a text."""
    texts = ["a \u2028", "a \u2029", "a \u0085", "a\n\u2028", "a \u2028 \n", " \n", "a b\r\n", "\u2028"]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert {r.doc_id: r.size for r in got} == dict(enumerate([2, 2, 2, 2, 2, 0, 2, 1]))
