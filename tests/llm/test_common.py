import os
from types import SimpleNamespace

import pytest

from corpuscule.llm import common


def session(folder, checkpoint, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, other: folder), sparkContext=SimpleNamespace(getCheckpointDir=lambda: checkpoint, setCheckpointDir=lambda x: None, master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_folder(session(None, None, master))
        assert common.shared_folder(session("hdfs://x/y/", None, master)) == "hdfs://x/y"
        assert common.shared_folder(session(None, "hdfs://z", master)) == "hdfs://z"
    assert common.shared_folder(session(None, None, "local[4]")).startswith("file://")


def test_scratch_tables_are_dropped(spark):
    scratch = common.Scratch(spark)
    first = scratch.cut(spark.range(5), "t")
    path = scratch.paths["t"].removeprefix("file://")
    assert first.count() == 5 and os.path.isdir(path)
    second = scratch.cut(first.where("id > 1"), "t")  # in place of the first, which it reads
    assert second.count() == 3 and not os.path.exists(path)
    scratch.drop("t", "none")
    assert scratch.paths == {}
