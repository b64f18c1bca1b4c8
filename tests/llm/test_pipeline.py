"""The pipeline's stages on the smallest table."""

import corpus_pipeline
from rangeloom.llm import langmix, quality, queries, simhash, suffixes
from rangeloom.llm.common import read_documents, stored
from tests.llm.test_content import shingle_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_documents(spark, SF)
    columns, ids, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        ids = now
        kept.append(docs.count())
        if name.startswith("SimHash"):
            assert len(now) == docs.count()
            want, _ = shingle_groups([r.text or "" for r in before])
            assert sorted(now) == sorted(min(r.doc_id for r, g in zip(before, want, strict=True) if g == group) for group in set(want))
        before = docs.select("doc_id", "text").collect() if name == "language ID" else None
    assert kept[0] == kept[1] > kept[2] == kept[3]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_registered_queries():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, _q int, _k int, _h int, _spans int, _text string, _id int, _hash int, _language string, `a.b` int, _kept int, key int"


def test_stages_keep_columns_of_any_name(spark, texts):
    rows = [(i, t, "en", "s", 0, i, i, i, i, f"own {i}", i, i, "x", i, i, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, CLASHES)
    for stage in (quality.accepted, langmix.accepted, simhash.one_of_each, suffixes.without_repeats):
        out = stage(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r["_text"] == f"own {r.doc_id}" and r["_q"] == r["a.b"] == r["_k"] == r.doc_id for r in got)


def test_unrelated_texts_of_one_id_stay(spark, texts):
    long = [t for t in texts if t and len(t) > 300]
    rows = [(3, long[0]), (5, long[0].replace("of", "off", 1)), (5, long[-1]), (5, long[-1])]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(3, long[0]), (5, long[-1])])


def test_run_on_an_empty_table(spark, tmp_path):
    read_documents(spark, SF).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
