import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import relational
from millrace.operators.recursive import fixpoint
from millrace.sources.arrow_ipc import register, write_table
from millrace.streaming import events


def test_arrow_ipc(spark, tmp_path):
    register(spark)
    spark.range(100).selectExpr("id", "cast(id as string) s").write.format("arrow_ipc").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("arrow_ipc").load(str(tmp_path / "out")).agg(F.sum("id")).first()[0] == 4950
    write_table(pa.table({"a": [1, None]}), str(tmp_path / "one.arrow"))
    assert spark.read.format("arrow_ipc").load(str(tmp_path / "one.arrow")).count() == 2


def test_stream_equals_table(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)) AS ts", "id % 7 AS user_id", "if(id % 3 = 0, 'a', 'b') AS event_type", "cast(id as double) AS value")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"), rows.schema, 1), "1 hour", late="30 days")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.windowed_counts(rows, "1 hour")
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, spark.table("w").collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert events.sessions(rows, "30 minutes").count() == 7


def test_catalog_is_published_whole(spark, tmp_path):
    from millrace.sources.store import Store

    store = Store(spark, f"file://{tmp_path}/db")
    one, two = store.read(), store.read()
    assert store.publish(one, 1) and not store.publish(two, 1) and store.latest() == 1
    # what a writer that died leaves behind is not read
    (tmp_path / "db/catalog/_2-dead").write_text('{"schemas"')
    assert store.read()["version"] == 1 and store.publish(store.read(), 2) and store.latest() == 2
    assert [p.name for p in (tmp_path / "db/catalog").iterdir() if p.name.startswith("_")] == ["_2-dead"]


def test_maintained_table(spark, tmp_path):
    from millrace.plans.engine import Engine

    s = Engine(spark, f"file://{tmp_path}/db").session()
    s.execute("CREATE TABLE e (id BIGINT, kind VARCHAR(5))")
    s.execute("CREATE MATERIALIZED VIEW per AS SELECT kind, count(*) AS n FROM e GROUP BY kind")
    rows = spark.range(40).selectExpr("id", "if(id % 4 = 0, 'a', 'b') AS kind")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    read = lambda: events.read_events(spark, str(tmp_path / "in"), rows.schema, 1)
    events.maintain(read(), s, "e", str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(map(tuple, s.execute("SELECT * FROM per").collect())) == [("a", 10), ("b", 30)]
    # a batch that is run again changes nothing
    assert s.append(("public", "e"), rows, mark=(str(tmp_path / "cp"), 0)) == 0
    assert s.execute("SELECT count(*) FROM e").first()[0] == 40


def test_fixpoint_nulls(spark):
    seed = spark.createDataFrame([(1, None), (1, None)], "a int, b int")
    out = fixpoint(seed, lambda w: w.selectExpr("(a + 1) % 3", "nullif(a, 1)"))
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == len(set(got)) and (1, None) in got


def test_except_by_count_and_broadcast(spark):
    a = spark.createDataFrame([(1,), (2,), (3,), (3,), (4,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (5,)], "k int")
    assert sorted(r[0] for r in relational.except_by_count(a, b).collect()) == [1, 3, 4]
    assert relational.broadcast_if_small(a).count() == 5
