from types import SimpleNamespace

import pytest
from stockflow.llm import common


def session(master, folder=None):
    conf = {common.CHECKPOINT_DIR: folder} if folder else {}
    get = lambda key, default=None: conf.get(key, default)
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get))
    return SimpleNamespace(conf=SimpleNamespace(get=get, set=conf.__setitem__), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_path(session(master), "x")
        assert common.shared_path(session(master, "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert common.shared_path(session("local[4]"), "x")


def test_a_task_gives_back_what_a_long_text_took():
    @common.frees
    def task(batches):
        for n in batches:
            common._powers(n)
            yield n

    assert list(task(iter([5, 3 * common.BLOCK_BYTES]))) == [5, 3 * common.BLOCK_BYTES]
    assert not common._POWERS
    list(task(iter([7])))
    assert len(common._POWERS["up"]) == common.BLOCK_BYTES + 1
