from pyspark.sql import functions as F

from palimpsest.functions import scalar


def test_json_functions(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, 2], "c": true}, "s": "x"}',), ("{}",), (None,)], "j string")
    got = df.select(
        scalar.json_get("j", "a", "b", 1).alias("b"), scalar.json_contains("j", {"a": {"c": True}, "s": "x"}).alias("has"), scalar.json_contains("j", {}).alias("all"), scalar.json_build_object(j=F.lit(1)).alias("o")
    ).collect()
    assert [tuple(r) for r in got] == [("2", True, True, '{"j":1}'), (None, False, True, '{"j":1}'), (None, False, True, '{"j":1}')]


def test_aggregates_and_series(spark):
    df = spark.createDataFrame([(1, "b", 2.5), (1, "a", None), (2, None, None)], "k int, s string, v double")
    got = df.groupBy("k").agg(scalar.total("v").alias("t"), scalar.group_concat("s", "-").alias("s"), scalar.json_agg("s").alias("j"), scalar.checksum_agg("s").alias("c")).orderBy("k").collect()
    assert [(r["t"], r["s"], r["j"]) for r in got] == [(2.5, "a-b", '["a","b"]'), (0.0, "", "[]")]
    objects = df.filter("s is not null").groupBy("k").agg(scalar.json_object_agg(F.col("s"), F.col("k")).alias("o")).first()
    assert objects["o"] == '{"a":1,"b":1}'
    assert [r[0] for r in spark.range(1).select(scalar.generate_series(1, 7, 3)).collect()] == [1, 4, 7]
    assert spark.range(1).select(scalar.epoch(F.lit("1970-01-01 00:00:01.5"))).first()[0] == 1.5
    assert spark.range(1).select(scalar.equals_any(F.lit("a"), F.array(F.lit("b"), F.lit("a")))).first()[0] is True
