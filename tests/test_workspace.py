"""Where written intermediates go."""

from types import SimpleNamespace

import pytest

from idsignal import workspace


class Context:
    applicationId = "app"

    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, setting=None):
    return SimpleNamespace(sparkContext=Context(master), conf=SimpleNamespace(get=lambda key, default: setting or default))


def test_the_clusters_folder_is_used():
    assert workspace.shared_dir(session("yarn", "hdfs://shared/ck/")) == "hdfs://shared/ck"


def test_a_cluster_without_the_setting_is_refused():
    with pytest.raises(RuntimeError):
        workspace.shared_dir(session("yarn"))


def test_a_local_session_makes_one_folder():
    local = session("local[2]")
    assert workspace.shared_dir(local) == workspace.shared_dir(local)


def test_stage_keeps_rows_and_never_reuses_a_path(spark):
    df = spark.range(10)
    assert workspace.stage(df, "t").count() == workspace.stage(df, "t").count() == 10
    assert workspace.fresh_path(spark, "t") != workspace.fresh_path(spark, "t")


def test_other_read_errors_raise(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.parquet").write_text("not parquet")
    assert workspace.read_existing(spark, str(tmp_path / "none"), "a int") is None
    with pytest.raises(Exception):
        workspace.read_existing(spark, str(tmp_path / "t"), "a int").collect()
