from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from veilframe.llm import common


def session(master, configured, directory=None):
    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k: configured if k == "spark.checkpoint.dir" else None), getCheckpointDir=lambda: directory, master=master, applicationId="app")
    return SimpleNamespace(sparkContext=context)


def test_shared_folder_is_the_sessions():
    assert common.shared_dir(session("spark://x:1", "s3a://b/c/")) == "s3a://b/c"
    assert common.shared_dir(session("yarn", None, "hdfs://n/d")) == "hdfs://n/d"
    with pytest.raises(ValueError):
        common.shared_dir(session("yarn", None))


def test_staged_rows_come_back(spark):
    df = spark.range(10).withColumn("x", F.array(F.col("id")))
    got = common.staged(df, "test")
    assert sorted(got.collect()) == sorted(df.collect()) and got.schema.simpleString() == df.schema.simpleString()
    assert common.staged(df.limit(0), "empty").count() == 0


def test_a_worker_holds_one_value():
    made = []
    make = lambda: made.append(1) or len(made)
    assert [common.per_worker(("a",), make), common.per_worker(("a",), make), common.per_worker(("b",), make), common.per_worker(("a",), make)] == [1, 1, 2, 3]


def test_folds_by_crc32(spark):
    import zlib

    got = spark.createDataFrame([(k,) for k in (0, 7, 123456789, -5, None)], "d long").select("d", common.crc_fold(F.col("d"), 5)).collect()
    assert [r[1] for r in got] == [zlib.crc32(str(r[0]).encode()) % 5 if r[0] is not None else 0 for r in got]
