"""State on streams that expires: replays in any order across a restart give what a table gives, and keys leave the state."""

import json
import random

from pyspark.sql import functions as F

from corvane.streaming import limits


def _run(df, path, name, mode="append"):
    q = df.writeStream.format("parquet" if name is None else "memory").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    q = q.option("path", f"{path}/out").outputMode(mode).start() if name is None else q.queryName(name).outputMode(mode).start()
    assert q.awaitTermination(180)
    return q


def test_replay_across_a_restart(spark, tmp_path):
    r = random.Random(6)
    rows = [(r.choice("abc"), i, 1000.0 + i * 20 + r.randrange(20)) for i in range(120)]
    schema = "key string, id long, at double"
    want = sorted(map(tuple, limits.token_bucket(spark.createDataFrame(rows, schema), 10).collect()))
    late = [x for k in range(0, 120, 30) for x in r.sample(rows[k : k + 30], 30)]  # shuffled within ten minutes
    for k, part in enumerate((late[:60], late[60:])):
        (spark.createDataFrame(part, schema) if k == 0 else spark.createDataFrame([*part, ("z", 999, 20_000.0)], schema)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = _run(limits.token_bucket_stream(source, 10, ordered=True), tmp_path, None)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").filter("id <> 999").collect()))
    assert got == want and not all(x[3] for x in got)
    # after the last event, hours later, every bucket is full again: only the newest key may still be held
    assert json.loads(q.lastProgress.json if hasattr(q.lastProgress, "json") else json.dumps(q.lastProgress))["stateOperators"][0]["numRowsTotal"] <= 1


def test_sessions(spark, tmp_path):
    rows = [("a", "2024-01-01"), ("a", "2024-01-20"), ("a", "2024-03-15"), ("b", "2024-01-05"), ("c", "2024-03-16")]
    df = spark.createDataFrame(rows, "who string, day string").select("who", F.to_timestamp("day").alias("at"))
    table = {(x.who, str(x.began)[:10], str(x.ended)[:10], x.events) for x in limits.sessions(df).collect()}
    assert table == {("a", "2024-01-01", "2024-02-19", 2), ("a", "2024-03-15", "2024-04-14", 1), ("b", "2024-01-05", "2024-02-04", 1), ("c", "2024-03-16", "2024-04-15", 1)}
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = _run(limits.sessions_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), tmp_path, "sessions")
    told = {(x.who, str(x.began)[:10], str(x.ended)[:10], x.events) for x in spark.table("sessions").collect()}
    assert told == {x for x in table if x[2] < "2024-03-15"} and q.lastProgress is not None
