import random

from pyspark.sql import functions as F

from narrata.operators.ordered import numbered


def test_places_of_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", None, "a", "b"]), rnd.randrange(10**9), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, at long, id long")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        got = numbered(df, ["k"], ["at", "id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want, seen = {}, {}
    for k, _, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[i] = seen.get(k, 0)
        seen[k] = want[i] + 1
    assert {r.id: r.place for r in got} == want and len(got) == len(rows)


def test_equal_rows_and_empty_tables(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.lit(2).alias("at"))
    assert sorted(r.place for r in numbered(df, ["k"], ["at"]).collect()) == list(range(100))
    assert numbered(df.limit(0), ["k"], ["at"]).count() == 0
