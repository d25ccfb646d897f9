from pyspark.sql import functions as F

from reelframe.operators import relations as ops


def test_first_present_ordinals_and_methods(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, pos int, v string")
    assert sorted(map(tuple, ops.first_by(df, ["k"], ["pos"]).collect())) == [("a", 1, "y"), ("b", 5, None)]
    known = spark.createDataFrame([("a",), ("z",)], "k string")
    here, gone = ops.present(df, known, "k")
    assert here.count() == 2 and [r.k for r in gone.collect()] == ["b"]
    assert {(r.k, r.missing) for r in ops.match_names(known, df.select("k", "v"), "k").collect()} == {("a", False), ("z", True)}
    assert [(r.pos, r.ordinal) for r in ops.at_ordinals(df, ["k"], ["pos"], [2]).collect()] == [(2, 2)]
    names = ["GetName", "Get", "Getter", "_GetX", "SetX", "Quit"]
    got = spark.createDataFrame([(n,) for n in names], "m string").select(ops.allowed(F.col("m"), ["Get", "Set"]).alias("a"))
    assert [r.a for r in got.collect()] == [True, True, False, False, True, False]
