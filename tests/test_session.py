"""Shared folder resolution: the session's setting wins; a local folder only
when none is set (no SparkContext handle needed)."""

import os

import pytest

from shelfmark.session import parallelism, require_conf, shared_dir


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _RemoteSession:
    """Looks like a session without a SparkContext handle."""

    def __init__(self, values):
        self.conf = _Conf(values)

    @property
    def sparkContext(self):
        raise RuntimeError("no SparkContext")


def test_session_setting_wins():
    s = _RemoteSession({"spark.checkpoint.dir": "hdfs://shared/ck/"})
    assert shared_dir(s) == "hdfs://shared/ck"


def test_local_folder_only_when_unset():
    s = _RemoteSession({"spark.sql.shuffle.partitions": "64", "spark.master": "local[2]"})
    d = shared_dir(s)
    assert os.path.isdir(d) and d.startswith("/tmp/run-")
    assert s.conf.get("spark.checkpoint.dir") == d        # reused by later calls
    assert shared_dir(s) == d
    assert parallelism(s) == 64


@pytest.mark.parametrize("master", ["yarn", "spark://head:7077", "local-cluster[3,2,3000]", ""])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_RemoteSession({"spark.master": master} if master else {}))


def test_operators_ask_for_settings():
    with pytest.raises(ValueError, match="configure"):
        require_conf(_RemoteSession({}), "spark.sql.variant.allowDuplicateKeys")
