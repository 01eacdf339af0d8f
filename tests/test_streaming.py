"""A query over a stream gives what it gives over the stored rows."""

from quernel.streaming import attach_stream, start

QUERY = "select k, count(*) as n, sum(v) as s from t where v > 2 group by k"


def test_stream_equals_batch(db, spark, tmp_path):
    path = f"file://{tmp_path}/in"
    rows = spark.range(100).selectExpr("id % 3 as k", "id as v")
    rows.write.parquet(path)
    attach_stream(db, "t", path, rows.schema)
    q = start(db.sql(QUERY), "out", f"file://{tmp_path}/cp", mode="complete", fmt="memory")
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in db.spark.sql("select k, n, s from out").collect())
    db.state.rels.clear()
    db.attach("t", path)
    assert got == sorted(tuple(r.values()) for r in db.many(QUERY))
