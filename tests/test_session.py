from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from spotloom import catalog, session


def test_staged_tables_of_a_block_are_removed_at_its_end(spark):
    with session.scratch(spark) as folder:
        staged = session.stage(spark.range(10))
        assert staged.count() == 10 and staged.inputFiles()[0].replace("file://", "file:").startswith(folder.replace("file://", "file:") if folder.startswith("file:") else f"file:{folder}")
    assert session.scratch_path(spark, "x").startswith(f"{session.shared_root(spark)}/spotloom/")
    with pytest.raises(Exception):
        spark.read.parquet(folder)


@pytest.mark.parametrize("master,options,fails", [
    ("local[8]", {"spark.sql.warehouse.dir": "file:/tmp/w"}, False),
    ("spark://a:1", {"spark.sql.warehouse.dir": "file:/tmp/w"}, True),
    ("local-cluster[2,1,1024]", {"spark.sql.warehouse.dir": "/tmp/w"}, True),
    ("yarn", {"spark.sql.warehouse.dir": "hdfs://a/w"}, False),
    ("yarn", {"spark.sql.warehouse.dir": "/tmp/w", "spark.checkpoint.dir": "hdfs://a/c"}, False),
])
def test_a_machine_local_folder_is_refused_on_a_cluster(master, options, fails):
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: options.get(k, d)), sparkContext=SimpleNamespace(master=master))
    if fails:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_root(fake)
    else:
        assert session.shared_root(fake) == options.get("spark.checkpoint.dir", options["spark.sql.warehouse.dir"])


def test_large_tables_are_shuffled_into_small_tasks(spark, tmp_path):
    size, first = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    kept = {k: spark.conf.get(k, None) for k in (size, first)}
    with open(tmp_path / "table.parquet", "wb") as f:
        f.truncate(30 * session.INPUT_MB << 20)
    try:
        spark.conf.set(size, "64m")
        spark.conf.unset(first)
        session.bound_tasks(spark, str(tmp_path))
        assert spark.conf.get(size) == f"{session.FETCH_MB}m"
        plan = spark.range(9).groupBy((F.col("id") % 3).alias("k")).count()._jdf.queryExecution().executedPlan().toString()
        assert ", 30), ENSURE_REQUIREMENTS" in plan
        # Settings that make smaller tasks are kept.
        spark.conf.set(size, "16k")
        spark.conf.set(first, "500")
        session.bound_tasks(spark, str(tmp_path))
        assert (spark.conf.get(size), spark.conf.get(first)) == ("16k", "500")
    finally:
        for k, value in kept.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def test_queries_bound_their_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    kept = spark.conf.get(size)
    spark.createDataFrame([(1, 2, "F", 3.0, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    try:
        spark.conf.set(size, "64m")
        catalog.load()[0]["set_05_sample_list_except"](spark, str(tmp_path))
        assert spark.conf.get(size) == f"{session.FETCH_MB}m"
    finally:
        spark.conf.set(size, kept)
