"""The pipeline stage by stage, the registry, and the queries' DuckDB twins."""

import os

import pytest

import corpus_pipeline as C
from logtide.llm import langid, lines, mixing, queries
from logtide.llm import jaccard

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def need_data():
    if not os.path.exists(SF):
        pytest.skip("no test data")


def test_stages(spark, tmp_path):
    need_data()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for i, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, kept[-1], SF)
        out.write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
        assert kept[-1].columns == COLUMNS if i < 4 else "ids_sha256" in kept[-1].columns
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    named = langid.identify(docs).filter("lang_pred != 'und' AND score >= 0.3")
    assert ids[1] == sorted(r.doc_id for r in named.collect())
    left = {r.doc_id: r.text for r in lines.dedup_lines(kept[1]).collect() if r.n_left or not r.n_removed}
    assert {r.doc_id: r.text for r in kept[2].collect()} == left
    assert all(r.n_chars == len(r.text) for r in kept[2].collect())
    firsts = {r.doc_id for r in jaccard.jaccard_classes(kept[2]).collect() if r.doc_id == r.class_id}
    assert ids[3] == sorted(firsts) and set(ids[3]) <= set(ids[2])
    taken = {r.doc_id: r.taken for r in mixing.mix(mixing.sized(kept[3])).collect()}
    words = {}
    for r in kept[4].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in taken.items() if n}
    assert ids[5] == ids[4]


def test_run_equals_the_stages_and_empty_tables_pass(spark, tmp_path):
    need_data()
    rows = C.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("names", [{}, {"size": "a.b", "taken": "tick`", "score": "N_LEFT", "links": "Key", "gone": "QUOTA"}])
def test_stages_on_odd_rows(spark, odd_docs, names):
    docs = odd_docs = odd_docs.withColumnsRenamed(names)
    for _, stage in C.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd_docs.columns
        rows = docs.collect()
        assert {r[-1] for r in rows} == {"x"} and {r[5:9] for r in rows} == {(-1, -2, -3.0, -4)}
        docs = spark.createDataFrame(rows, odd_docs.schema)
    assert docs.count() > 0 and C.STAGES[4][1](spark, docs, SF).count() == docs.count()


def test_registry(spark):
    names = sorted(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "mixing", "byte_bpe"]
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_duckdb_twin(spark, name):
    need_data()
    import oracle_check as OC

    got = OC.compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], OC.duck(SF), SF)
    assert got["ok"], got
