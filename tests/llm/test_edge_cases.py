"""Every operator on nulls, empty and long texts, repeated rows, clashing column
names and empty tables: defined results, no row lost."""

import pytest

from tillpoint.llm import binary_output, decontam, langid, mixing, quality, simhash, substring, suffix_tree, token_counts, toxicity

N = 12


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def bench(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string")


RUNS = {
    "op1": lambda spark, d: langid.identify(d, langid.fit(d)),
    "op2": lambda spark, d: quality.judge(d, quality.fit(d, labels(spark))),
    "op4": lambda spark, d: simhash.near_duplicates(d.select("doc_id", "text")),
    "op5": lambda spark, d: toxicity.score(d, toxicity.fit(d, labels(spark))),
    "op7": lambda spark, d: binary_output.token_files(d.select("doc_id", "text")),
    "op8": lambda spark, d: suffix_tree.score(d.select("doc_id", "text")),
    "op10": lambda spark, d: token_counts.token_counts(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_a_document(spark, odd, none, name):
    rows = RUNS[name](spark, odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect()) and len(rows) == N
    assert RUNS[name](spark, none).collect() == []


def test_empty_texts_have_the_documented_results(spark, odd):
    lang = {r.doc_id: r for r in RUNS["op1"](spark, odd).collect()}
    assert all((lang[i].lang_pred, lang[i].score) == ("und", 0.0) for i in (1, 2, 3, 10))
    kept = {r.doc_id: r for r in RUNS["op2"](spark, odd).collect()}
    assert kept[1].base_failed and kept[1].n_words == 0 and not kept[2].kept and kept[5].kept
    fp = {r.doc_id: r for r in RUNS["op4"](spark, odd).collect()}
    assert fp[1].fp == fp[2].fp == fp[3].fp == 0 and {fp[i].component_id for i in (1, 2, 3)} == {1}
    assert fp[5].component_id == fp[6].component_id == 5
    ids = {r.doc_id: r for r in RUNS["op7"](spark, odd).collect()}
    assert ids[1].n_tokens == ids[2].n_tokens == 1 and ids[None].start == 0
    lm = {r.doc_id: r for r in RUNS["op8"](spark, odd).collect()}
    assert lm[1].n_tokens == lm[3].n_tokens == 1 and lm[4].n_tokens == 2
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in RUNS["op10"](spark, odd).collect()}[2] == (0, 0)


def test_mix(spark, odd, none):
    base = mixing.sized(odd)
    drawn, sources = mixing.mix(base)
    rows = {r.skey: r for r in sources.collect()}
    assert set(rows) == {"0s0", "0", "1"}  # named, empty and null source
    assert sum(r.target for r in rows.values()) == pytest.approx(1.5 * sum(r.source_size for r in rows.values()))
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() >= 1
    assert mixing.mixed_documents(none).count() == 0 and mixing.mix(mixing.sized(none))[1].count() == 0


def test_filters_keep_columns_and_clean_rows(spark, odd, none, make):
    from tests.llm.conftest import sentence
    assert toxicity.without_toxic(odd, None).count() == N
    clean = decontam.without_leaks(odd, bench(spark, [(1, sentence(3, 60)), (2, None), (3, "  "), (4, "")]))
    assert clean.columns == odd.columns and 8 not in {r.doc_id for r in clean.collect()} and clean.count() == N - 1
    assert decontam.without_leaks(odd, bench(spark)).count() == N and decontam.without_leaks(none, bench(spark, [(1, "a b c")])).count() == 0
    assert decontam.leaks(odd, bench(spark)).collect() == []
    one = simhash.keep_one(odd)
    ids = [r.doc_id for r in one.collect()]
    assert one.columns == odd.columns and sorted(i for i in ids if i is not None) == [1, 4, 5, 7, 8, 9, 10] and ids.count(None) == 1
    assert simhash.keep_one(none).count() == 0


def test_texts_with_one_id_are_judged_one_by_one(make):
    from tests.llm.conftest import sentence
    a, b, c = (sentence(k, 60) for k in (11, 12, 13))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c), (3, a), (4, sentence(14, 60)), (None, a)]
    left = [(r.doc_id, r.text) for r in simhash.keep_one(make(rows, extra=True)).collect()]
    assert sorted(left, key=str) == sorted([(1, a), (1, b), (3, c), rows[6], (None, a)], key=str)


def test_substring(spark, odd, none):
    cut = {r.doc_id: r for r in substring.remove_repeats(odd.select("doc_id", "text")).collect()}
    assert set(cut) == {5, 6} and cut[5].n_removed == 60 and cut[5].kept_text == ""
    assert substring.remove_repeats(none.select("doc_id", "text")).count() == 0


def test_pipeline_on_an_empty_table(spark, none, tmp_path):
    import corpus_pipeline

    none.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
