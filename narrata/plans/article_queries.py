"""Queries of web articles, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.operators import articles as A
from narrata.plans import text_queries as TQ
from narrata.sources.tables import table


def t34_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and the body's characters without white space."""
    a = A.extract_articles(table(spark, sf_dir, "pages"))
    return a.select("page_id", "title", "author", "published", F.length(F.regexp_replace("body", r"(?U)\s+", "")).cast("long").alias("n_chars"))


def t35_linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's whole html as the article of linked data in that page, read back, behind an empty one and before a broken one."""
    own = F.replace(F.to_json(F.struct(F.col("html").alias("articleBody"))), F.lit("</"), F.lit("<\\/"))
    data = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"articleBody":" "},{"x":'), own, F.lit('}]}</script><script type="application/ld+json">{bad</script>'))
    made = table(spark, sf_dir, "pages").select("page_id", F.concat(data, "html").alias("html"))
    return A.linked_data(made).select("page_id", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("digest"))


def t18_article_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as they are read: extracted, cleaned and counted; tested on small pages."""
    return A.article_table(table(spark, sf_dir, "pages")).select("page_id", "title", "word_count", F.md5("content").alias("digest"))



QUERIES = {f.__name__: f for f in (t34_articles, t35_linked_data, t18_article_table)}
ORACLE_SQL = {
    "t35_linked_data": "select page_id, length(t) as n_chars, md5(t) as digest from (select page_id, " + TQ.strip_sql("html") + " as t from pages)",
}
