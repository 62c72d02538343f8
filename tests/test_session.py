import os
import types

import pytest

from pelorus import session as S


def test_without_a_shared_folder_a_cluster_is_an_error():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: types.SimpleNamespace(get=lambda k: None))

    with pytest.raises(RuntimeError):
        S.shared_dir(types.SimpleNamespace(sparkContext=Context()))


def test_what_was_stored_can_be_deleted(spark):
    path = S.shared_path(spark, "x")
    df = S.stored_at(spark.range(5).toDF("id"), path)
    assert df.count() == 5 and path.startswith(S.own_dir(spark))
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    S.release(spark, path)
    assert not os.path.exists(local)
