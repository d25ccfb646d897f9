import os

from reelframe.llm import work


def folders(spark):
    root = work.shared_dir(spark).removeprefix("file://") + "/reelframe"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_scratch_tables_go(spark):
    before = folders(spark)
    one = work.table(spark.range(3).toDF("a"), "one")
    with work.scratch(spark):
        two = work.table(one.where("a > 0"), "two")
        assert two.count() == 2 and len(folders(spark) - before) == 2
    assert len(folders(spark) - before) == 1 and one.count() == 3
    work.discard(one)
    assert folders(spark) == before
