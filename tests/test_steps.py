import json

import pytest
from pyspark.sql import functions as F

from lumengrid.operators import gate, steps
from lumengrid.sources import files, sampling, store


def test_write_step_and_markers(spark, tmp_path):
    df = spark.range(100).withColumn("bucket", F.col("id") % 4)
    out = steps.write_step(df, str(tmp_path / "t"), tmp_path / "done", "t", by=("bucket",), config=steps.fingerprint({"rank": 64}))
    assert out["rows"] == 100 and steps.read_marker(tmp_path / "done", "t")["config"] == steps.fingerprint({"rank": 64})
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100
    steps.require(tmp_path / "done", "t")
    with pytest.raises(RuntimeError):
        steps.require(tmp_path / "done", "t", "other")
    with pytest.raises(ValueError):
        steps.assert_rows(df, 101, "t")


def test_lines(tmp_path):
    path = tmp_path / "log.jsonl"
    assert steps.read_lines(path) == []
    steps.append_lines(path, [{"id": 1}, {"id": 2}])
    with path.open("a") as f:
        f.write('{"id": 3')
    assert [r["id"] for r in steps.read_lines(path)] == [1, 2]
    path.write_text('{"id": 1\n{"id": 2}\n')
    with pytest.raises(ValueError):
        steps.read_lines(path)


def test_pending_chunked_tables(spark):
    t, done = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(2,), (None,)], "k int")
    assert sorted(r.k for r in steps.pending(t, "k", done).collect()) == [1, 3]
    assert sorted(r.k for r in steps.pending(t, "k", done, spark.createDataFrame([(3,)], "k int")).collect()) == [1]
    assert list(steps.chunked([1, 2, 3], 2)) == [[1, 2], [3]]
    with pytest.raises(ValueError):
        list(steps.chunked([1], 0))
    t.createOrReplaceTempView("movies")
    assert steps.known_table(spark, "movies", ("movies",)).count() == 3
    with pytest.raises(ValueError):
        steps.known_table(spark, "x; drop", ("movies",))


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text('user_id,item_id,rating,timestamp\n1,2,3.5,0\n1,"3",4.0,1000000000\n')
    r = files.by_year(files.read_csv(spark, str(tmp_path / "r.csv"), files.RATINGS))
    assert [x.rating_year for x in r.orderBy("item_id").collect()] == [1970, 2001]
    files.write_partitioned(r, str(tmp_path / "p"), "rating_year")
    assert spark.read.parquet(str(tmp_path / "p")).where("rating_year = 2001").count() == 1
    (tmp_path / "e.json").write_text('{"adult":false,"id":7,"original_title":"t","popularity":1.5,"video":false}\n')
    assert files.read_json_lines(spark, str(tmp_path / "e.json"), files.EXPORT).first().id == 7
    for n in (40, 11):  # shards of the larger set don't outlive it
        assert files.write_shards(spark.range(n).select((F.col("id") * 3).alias("item_id")), str(tmp_path / "s"), 5) == -(-n // 5)
    assert {r.shard: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().collect()} == {0: 5, 1: 5, 2: 1}


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        store.published(spark, root)
    old = store.publish(spark.range(5).withColumnRenamed("id", "item_id"), root)
    store.publish(spark.range(100).withColumnRenamed("id", "item_id"), root)
    assert store.published(spark, root).count() == 100 and spark.read.parquet(old).count() == 5
    assert store.clean(spark, root) == 1 and store.lookup(spark, root, 42).count() == 1 and store.lookup(spark, root, 100).count() == 0


def test_sampling(spark):
    df = spark.range(200_000).withColumnRenamed("id", "user_id")
    one = {r.user_id for r in sampling.sampled(df, "ratings", True, "user_id").collect()}
    assert 1700 < len(one) < 2300 and one == {r.user_id for r in sampling.sampled(df.repartition(7), "ratings", True, "user_id").collect()}
    assert sampling.sampled(df, "movies", True, "user_id") is df and sampling.sampled(df, "ratings", False, "user_id") is df
    with pytest.raises(ValueError):
        sampling.share("other", True)


def test_up_to_date(tmp_path):
    steps.write_marker(tmp_path, "cf", 5, config=steps.fingerprint({"rank": 64}))
    assert steps.up_to_date(tmp_path, "cf", {"rank": 64}) and not steps.up_to_date(tmp_path, "cf", {"rank": 32}) and not steps.up_to_date(tmp_path, "other", {})


def result(value, mode="full", at="2024-01-01"):
    return {"mode": mode, "generated_at": at, "rankers": {"hybrid": {"precision@10": value}}}


def test_gate(tmp_path):
    assert gate.passes(result(0.1), result(0.1)) and not gate.passes(result(0.09), result(0.1))
    with pytest.raises(ValueError):
        gate.passes(result(0.1, "sample"), result(0.1))
    folder, base = tmp_path / "results", tmp_path / "base.json"
    folder.mkdir()
    assert gate.run_gate(folder, base) == 2
    (folder / "a.json").write_text(json.dumps(result(0.2)))
    (folder / "b.json").write_text(json.dumps(result(0.05, at="2024-02-01")))
    gate.promote(result(0.1), base, "first")
    assert gate.run_gate(folder, base) == 1
    (folder / "c.json").write_text(json.dumps(result(0.1, at="2024-03-01")))
    assert gate.run_gate(folder, base) == 0
