import pytest

from rasterloom import session


def test_local_tables(spark):
    rows = [("a", 1, None), (None, 2, 0.5)]
    df = session.local_table(spark, rows, "x string, y long, z double")
    assert [tuple(r) for r in df.collect()] == rows and df.dtypes == [("x", "string"), ("y", "bigint"), ("z", "double")]
    assert session.local_table(spark, [], "x string").collect() == []
    assert "Python" not in df._jdf.queryExecution().toString()


def test_few_files(spark):
    df = spark.range(0, 1000, 1, 16)
    assert session.few_files(df, 1000, 300).rdd.getNumPartitions() == 4
    assert session.few_files(df, 10_000, 300).rdd.getNumPartitions() == 16
    assert session.few_files(df, 0, 300).rdd.getNumPartitions() == 1


def test_stored_tables(spark):
    df = session.stored(spark, spark.range(50).repartition(8), "test", rows=50)
    assert df.count() == 50 and len(df.inputFiles()) == 1
    assert df.inputFiles()[0].startswith(session.shared_dir(spark).replace("file://", "file:").replace("file:", "file://"))
    session.drop_stored(spark, df)
    with pytest.raises(Exception, match="not exist|cannot be found|FILE_NOT_EXIST"):
        df.collect()


def test_bounds_do_not_replace_the_application_s(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    session.bound_batches(spark)
    assert spark.conf.get(key) == "512"
    session.give_back(spark)
