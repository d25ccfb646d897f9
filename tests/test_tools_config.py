import pytest
from reelframe.operators import timeline
from reelframe.plans import tools


def test_configuration_files(tmp_path):
    path, defaults = tmp_path / "c.json", {"a": 1, "b": 2}
    assert tools.read_config(path, defaults) == defaults
    path.write_text(" \n")
    assert tools.read_config(path, defaults) == defaults
    path.write_text('{"b": 3, "new": [1]}')
    assert tools.read_config(path, defaults) == {"a": 1, "b": 3, "new": [1]}
    for text, message in (("{", "no valid JSON"), ("[1]", "must hold"), ("null", "must hold")):
        path.write_text(text)
        with pytest.raises(ValueError, match=message):
            tools.read_config(path, defaults)


def test_a_grid_given_inline_or_analysed(spark):
    inline = timeline.resolve_grid(spark, [0, 0.5, 1.25], value="t")
    assert [tuple(r) for r in inline.orderBy("t").collect()] == [("t", 0), ("t", 500), ("t", 1250)]
    analysed = spark.createDataFrame([("t", 0, 7, 120.0)], "timeline string, i long, t long, bpm double")
    assert [tuple(r) for r in timeline.resolve_grid(spark, analysed).collect()] == [("t", 7)]
