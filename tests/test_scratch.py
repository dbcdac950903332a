import os

import pytest

from talkloom import scratch
from talkloom.sinks import tables


def test_uses_the_folder_the_cluster_names(spark):
    assert scratch.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_folder_of_the_context_where_it_is_unset(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_CONF", "spark.talkloom.unset")

    class Session:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            folder = "hdfs:/shared/"

            @classmethod
            def getCheckpointDir(cls):  # noqa: N802
                return cls.folder

    assert scratch.scratch_root(Session) == "hdfs:/shared"
    Session.sparkContext.folder = None
    with pytest.raises(RuntimeError, match="set spark.talkloom.unset"):
        scratch.scratch_root(Session)


def test_a_materialised_table_is_cut_from_its_plan(spark):
    df = scratch.materialise(spark.range(5).selectExpr("id * 2 AS n"), "t")
    assert sorted(r.n for r in df.collect()) == [0, 2, 4, 6, 8]
    assert "Range" not in df._jdf.queryExecution().toString()


def test_a_scope_removes_its_tables(spark, tmp_path):
    with scratch.scratch_scope(spark):
        df = scratch.materialise(spark.range(5), "scoped")
        folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(folder) and df.count() == 5
    assert not os.path.exists(folder)


def test_replacing_a_table_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3), path)
    tables.replace_table(spark.read.parquet(path).selectExpr("id + 1 AS id"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    os.rename(path, f"{path}.old")  # lost between the two renames
    tables.restore_table(spark, path)
    assert spark.read.parquet(path).count() == 3 and sorted(os.listdir(tmp_path)) == ["t"]
