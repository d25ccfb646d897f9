"""Every query with SQL gives the rows that DuckDB gives on the same tables; the others run."""

import math

import duckdb
import pytest

from reelframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows(records, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted(tuple(str(plain(r[i])) for i in at) for r in records)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    wanted = sorted(got.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns, wanted) == rows(rel.fetchall(), rel.columns, wanted)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(spark, name):
    assert registry.queries()[name](spark, SF).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tools():
    from reelframe.plans import tools

    assert tools.check_arguments({"a": 1}, ["a", "b"], ["b"]) == "missing required argument(s): b"
    assert tools.check_arguments({"a": 1, "z": 1}, ["a"], ["a"]) == "unknown argument(s): z" and tools.check_arguments({}, [], []) is None
    assert tools.overlay({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}
    with pytest.raises(ValueError):
        tools.overlay({}, [1])


def test_a_cycle_of_folders_is_an_error(spark):
    from reelframe.plans import tools

    f = spark.createDataFrame([(1, None, "root"), (2, 1, "a"), (3, 2, "b")], "id int, parent int, name string")
    assert {r.path for r in tools.walk(f).collect()} == {"root", "root/a", "root/a/b"}
    with pytest.raises(ValueError):
        tools.walk(f, depth=2)


def test_color_match_where_a_pixel_meets_the_limit_of_a_mask(spark, tmp_path):
    con = duckdb.connect()
    part = f"'{SF.replace('sf0.001', 'sf0.1')}/part.parquet'"
    con.execute(f"COPY (SELECT * FROM {part} WHERE p_partkey // 100 IN (1, 6, 88, 153) ORDER BY p_partkey) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = registry.queries()["color_match"](spark, str(tmp_path))
    rel = con.sql(registry.oracle_sql()["color_match"])
    wanted = sorted(got.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns, wanted) == rows(rel.fetchall(), rel.columns, wanted)


@pytest.mark.parametrize(("name", "exchanges"), [("chapter_description", 1), ("chapters_greedy", 0)])
def test_chapters_shuffle_no_words(spark, tmp_path, name, exchanges):
    """Texts that end in a line break among them: the empty word there begins no chapter."""
    texts = ["Hello world.\n", "", None, "   ", "\n", "\nOne two. three", "a. " * 400, "No stops here " * 500, 'Said.\" And on, so. ' * 200 + "\n", "\n" + "b. " * 300 + "\n", "One."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    assert got._jdf.queryExecution().sparkPlan().toString().count("Window") == 0
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == exchanges
    rel = con.sql(registry.oracle_sql()[name])
    wanted = sorted(got.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns, wanted) == rows(rel.fetchall(), rel.columns, wanted)
