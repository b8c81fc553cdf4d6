"""Size-guarded helpers: broadcasting small sides, shared folders, tables by
content."""

import pytest

from newsweave import session
from newsweave.session import broadcast_if_small, estimated_bytes, materialised

from conftest import SF_SMALL


def _analyzed(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_broadcast_only_behind_the_size_check(spark):
    small = spark.read.parquet(f"{SF_SMALL}/region.parquet")
    assert 0 < estimated_bytes(small) < 1 << 20
    assert "broadcast" in _analyzed(broadcast_if_small(small)).lower()
    assert "broadcast" not in _analyzed(broadcast_if_small(small, max_bytes=0)).lower()
    # a join estimate that overflows a long is reported as "huge", not an error
    big = spark.range(10**6).crossJoin(spark.range(10**6)).crossJoin(spark.range(10**6))
    assert estimated_bytes(big) >= 1 << 40


class _Cluster:
    """A session on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return _Cluster.conf

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Cluster)


def test_new_data_under_a_path_is_a_new_table(spark, tmp_path):
    def total():
        return materialised(spark, str(tmp_path), "t", ["numbers"],
                            lambda: spark.read.parquet(f"{tmp_path}/numbers.parquet")).count()

    spark.range(5).write.parquet(f"{tmp_path}/numbers.parquet")
    assert total() == total() == 5
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/numbers.parquet")
    assert total() == 8
