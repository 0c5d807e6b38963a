"""Places and running totals by ranges."""

from pyspark.sql import functions as F

from tessera.operators.ranges import place, running_total


def test_places_follow_the_order_with_nulls_first(spark):
    rows = spark.createDataFrame([(3, "a"), (None, "b"), (1, "c"), (2, "d")], "k int, x string")
    assert {(r.x, r.place) for r in place(rows, ["k"]).collect()} == {("b", 0), ("c", 1), ("d", 2), ("a", 3)}


def test_places_of_a_hot_key_are_split_and_whole(spark):
    n = 20_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), "id")
    found = place(rows.repartition(5), ["k"], total="n").collect()
    assert sorted(r.place for r in found) == list(range(n)) and {r.n for r in found} == {n}
    ordered = [r.k for r in sorted(found, key=lambda r: r.place)]
    assert ordered == sorted(ordered)


def test_places_within_groups_and_descending(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), "id")
    found = place(rows, [F.desc("id")], within=["g"], total="n").collect()
    for g in "012":
        mine = sorted((r for r in found if r.g == g), key=lambda r: r.place)
        assert [r.id for r in mine] == sorted((r.id for r in mine), reverse=True)
        assert [r.place for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)}


def test_running_totals(spark):
    rows = spark.range(1, 501).select("id", (F.col("id") * 2).alias("v"))
    found = {r.id: r.upto for r in running_total(rows, ["id"], "v", "upto").collect()}
    assert found == {i: i * (i - 1) for i in range(1, 501)}


def test_no_rows(spark):
    assert place(spark.range(0), ["id"], total="n").collect() == []
