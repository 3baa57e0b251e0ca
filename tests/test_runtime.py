"""Checkpoint-folder resolution: read from the session, set only when unset."""

from marquee.runtime import ensure_checkpoint_dir, scratch_path


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _NoContextSession:
    """Looks like a Spark Connect session: a conf, but no SparkContext."""

    def __init__(self, values):
        self.conf = _Conf(values)

    @property
    def sparkContext(self):
        raise RuntimeError("no SparkContext in this session")


def test_connect_session_uses_configured_folder():
    s = _NoContextSession({"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs:///shared/ckpt"
    assert scratch_path(s, "t").startswith("hdfs:///shared/ckpt/tables/t-")


def test_connect_session_falls_back_to_warehouse():
    s = _NoContextSession({"spark.master": "k8s://api", "spark.sql.warehouse.dir": "s3a://bucket/warehouse/"})
    assert ensure_checkpoint_dir(s) == "s3a://bucket/warehouse/_checkpoints"


def test_classic_session_keeps_its_folder(spark):
    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first
    assert spark.sparkContext.getCheckpointDir() == first
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(first)


def test_build_session_keeps_a_running_master(spark):
    from marquee.runtime import build_session

    before = (spark.sparkContext.master, spark.conf.get("spark.sql.shuffle.partitions"))
    again = build_session()
    assert (again.sparkContext.master, again.conf.get("spark.sql.shuffle.partitions")) == before


def test_cluster_without_shared_folder_fails_fast():
    import pytest

    yarn_local_wh = _NoContextSession({"spark.master": "yarn", "spark.sql.warehouse.dir": "file:/home/u/wh"})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(yarn_local_wh)
    yarn_shared_wh = _NoContextSession({"spark.master": "yarn", "spark.sql.warehouse.dir": "hdfs://nn/wh"})
    assert ensure_checkpoint_dir(yarn_shared_wh) == "hdfs://nn/wh/_checkpoints"
    local_session = _NoContextSession({"spark.master": "local[4]", "spark.sql.warehouse.dir": "file:/tmp/wh"})
    assert ensure_checkpoint_dir(local_session) == "file:/tmp/wh/_checkpoints"


def test_single_slash_schemes_are_shared():
    s = _NoContextSession({"spark.master": "yarn", "spark.sql.warehouse.dir": "dbfs:/user/hive/warehouse"})
    assert ensure_checkpoint_dir(s) == "dbfs:/user/hive/warehouse/_checkpoints"
