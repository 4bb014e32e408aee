import corpus_pipeline
from llm.queries import llm_oracles, llm_queries
from llm.tokens import default_path, encoder

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        counts.append(docs.count())
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] > 0
    assert counts[3] == counts[4] and any("<EMAIL>" in t for t in texts.values())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    own = encoder(default_path()).tokenizer
    assert {r.doc_id: r.ids for r in out} == {i: own.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_stages_handle_odd_tables(spark, messy):
    for df in (messy, messy.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF).persist()
            df.count()


def test_every_query_is_named_after_its_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in llm_queries())
    assert numbers == list(range(1, 14)) and set(llm_oracles()) <= set(llm_queries())
