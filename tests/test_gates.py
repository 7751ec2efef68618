"""Gates on small tables, and the chunkers' SQL on texts made to reach each of their levels."""

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.compare import difference

from narrata.functions import gates as G
from narrata.plans import registry


def one(spark, column, schema, *values):
    return [r[0] for r in spark.createDataFrame(list(values), schema).select(column).collect()]


def test_articles_at_the_bounds(spark):
    rows = [("x", 39), ("x", 40), ("x", 119), ("x", 120), ("üü", 500), ("üüx", 500), ("üüx", 1), (None, 500), ("x", None)]
    got = one(spark, G.article_status(F.col("html"), F.col("n"), most_bytes=4), "html string, n int", *rows)
    assert got == ["rejected", "fallback", "fallback", "ok", "ok", "too_large", "too_large", "rejected", "rejected"]
    assert G.ARTICLE_BYTES == 12_582_912


def test_previews(spark):
    texts = [("ü" * 500,), ("ü" * 501,), ("",), (None,)]
    assert one(spark, G.preview_rejected(F.col("t")), "t string", *texts) == [False, True, False, False]
    assert one(spark, G.preview_of(F.col("t")), "t string", *texts) == ["ü" * 500, "ü" * 500, "", None]


def test_session_folders(spark):
    ids = [("a" * 11,), ("a" * 12,), ("A-9" * 12,), ("a" * 37,), ("../../etc/passwd",), ("a" * 12 + "\n",), ("ä" * 12,), ("",), (None,)]
    assert one(spark, G.session_path(F.col("s"), "root"), "s string", *ids) == [None, "root/" + "a" * 12, "root/" + "A-9" * 12, *[None] * 6]


LINES = "\n".join(f"Line {i} of a text, with words; and more: to come." for i in range(300))
TEXTS = [
    "",
    "   \n ",
    "One. Two! Three? four. Five",
    "word " * 2000,
    "w" * 5000 + " tail",
    "Short. " + "clause of some words, another; a third: " * 60 + "end. Last one.",
    "ü" * 2048,
    "ü" * 2049 + ". Next",
    LINES,
    "Head.\n" + "A sentence of nine words stands here again, yes. " * 200 + "\nFoot.\n\nEnd.",
    "x" * 201 + " y. z " + "ab " * 100 + ". " + "q" * 200 + ". Done",
    ";;; ,, a;b;c " + "long;" * 100,
    "No stop " * 300 + "\n" + "t " * 3000 + "\nlast",
    '"Quoted." "Again." ' * 100,
]


@pytest.mark.parametrize("name", ["c01_chunk_words", "c02_chunk_words_clauses", "c03_chunk_words_simple", "c04_chunk_tokens", "c05_chunk_bytes", "c08_rechunk_failed", "c09_highlight_chunks"])
def test_chunks_of_odd_texts_equal_their_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], str(tmp_path)) == ""
