"""The shared folder, staged tables, and the entry without the training-text part."""

import importlib
import os
import sys
from types import SimpleNamespace

import pytest

import __spark_entry__
from lexigrove import session
from lexigrove.queries import CORE_QUERIES


def cluster(master, folder=None):
    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda key: folder), getCheckpointDir=lambda: None, master=master)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://https://host"])
def test_clusters_need_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        session.shared_dir(cluster(master))
    assert session.shared_dir(cluster(master, "hdfs://x/shared/")) == "hdfs://x/shared"


def test_staged_tables_are_released(spark):
    one, two = session.stage(spark.range(5)), session.stage(spark.range(7))
    assert one.count() == 5 and os.path.isdir(one._staged_path.removeprefix("file:"))
    session.release(one)
    assert not os.path.isdir(one._staged_path.removeprefix("file:")) and two.count() == 7
    session.release_staged(spark)
    assert not os.path.isdir(two._staged_path.removeprefix("file:"))


def test_entry_without_training_text(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("lexigrove.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lexigrove.llm", None)
    alone = importlib.reload(__spark_entry__)
    assert set(alone.queries()) == set(CORE_QUERIES) and set(alone.oracle_sql()) <= set(CORE_QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
