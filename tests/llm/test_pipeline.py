from pyspark.sql import functions as F

import corpus_pipeline as P
from narrata.llm.common import staged, table


def test_stages_keep_the_columns_and_clean_documents(spark, sf):
    docs = table(spark, sf, "documents")
    names, seen = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf), name.replace(" ", "_"))
        assert docs.columns == names
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.7 * seen[0]
    last = P.STAGES[-1][1](spark, docs, sf)
    assert last.count() == seen[-1] and last.where("n_tokens IS NULL").count() == 0


def test_columns_of_any_name_stay(spark, sf, odd_docs):
    names = ["_id", "__id", "_TEXT_HASH", "__text_hash", "marks", "head", "digest"]
    docs = odd_docs.where("doc_id < 8").withColumns({c: F.lit(c) for c in names})
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        rows = out.select(*names).distinct().collect()
        assert out.columns == docs.columns and [list(r) for r in rows] == [names]


def test_stages_on_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in P.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count()
