"""Batches of visits change the user table in place, once each."""

import datetime as dt
import os
import random

from riskframe.operators.joins import new_users, upsert_users
from riskframe.operators.user_table import apply_batch, read_users
from riskframe.session import scratch_path

T0 = dt.datetime(2024, 1, 1)
EVENTS = "name string, ts timestamp_ntz, kind string"


def brute(batches):
    users = {}
    for events in batches:
        for name, ts, kind in events:
            key = None if name is None else name.strip(" ").lower()
            u = users.setdefault(key, [ts, ts, 0, 0])
            u[0], u[1] = min(u[0], ts), max(u[1], ts)
            u[2 + (kind == "evaluation")] += 1
    return users


def state(spark, path):
    rows = read_users(spark, path).collect()
    assert len({r["user_id"] for r in rows}) == len(rows) and all((r["user_id"] - 1) % 8 == r["bucket"] for r in rows)
    return {None if r["name"] is None else r["name"].lower(): [r["created_at"], r["last_seen"], r["visits"], r["evaluations"]] for r in rows}


def test_two_batches_and_a_replay(spark):
    rng = random.Random(1)
    names = [None, " Ana ", "ana", "ANA", "Luis", "María"] + [f"user {i}" for i in range(40)]
    batches = [[(rng.choice(names), T0 + dt.timedelta(days=b, minutes=i), rng.choice(["visit", "visit", "evaluation"])) for i in range(200)]
               for b in range(3)]
    path = scratch_path(spark, "users")
    frames = [spark.createDataFrame(b, EVENTS) for b in batches]
    for k, df in enumerate(frames):
        apply_batch(spark, path, df, k, buckets=8)
        if k:
            apply_batch(spark, path, df, k, buckets=8)  # once more, as after a failure
        assert state(spark, path) == brute(batches[:k + 1])
    ids = {r["name"]: r["user_id"] for r in read_users(spark, path).collect()}
    apply_batch(spark, path, frames[2], 2, buckets=8)
    assert {r["name"]: r["user_id"] for r in read_users(spark, path).collect()} == ids
    apply_batch(spark, path, frames[0].limit(0), 3, buckets=8)
    assert state(spark, path) == brute(batches)


def test_only_touched_buckets_are_rewritten(spark):
    path = scratch_path(spark, "users")
    apply_batch(spark, path, spark.createDataFrame([(f"u{i}", T0, "visit") for i in range(100)], EVENTS), 0, buckets=8)
    files = {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("bucket=")}
    apply_batch(spark, path, spark.createDataFrame([("U5 ", T0, "evaluation")], EVENTS), 1, buckets=8)
    after = {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("bucket=")}
    assert len(files) == 8 and sum(files[d] != after[d] for d in files) == 1


def test_a_missing_name_is_one_user(spark):
    users = spark.createDataFrame([(1, "Ana", T0, T0, 1, 0), (2, None, T0, T0, 3, 0)],
                                  "user_id bigint, name string, created_at timestamp_ntz, last_seen timestamp_ntz, visits bigint, evaluations bigint")
    visits = spark.createDataFrame([(None, T0), (None, T0), (" ANA", T0), ("Eva", T0)], "name string, ts timestamp_ntz")
    got = {r["name"]: (r["user_id"], r["visits"]) for r in upsert_users(users, visits).collect()}
    assert got == {"Ana": (1, 2), None: (2, 5), "Eva": (3, 1)}
    assert [r["name"] for r in new_users(users, visits).collect()] == ["Eva"]


def test_activity_of_many_users_holds_no_stream_state(spark):
    from pyspark.sql import functions as F

    from riskframe.streaming import jobs as ST
    from riskframe.operators.user_table import count_activity, read_activity
    path, sink, ckpt = (scratch_path(spark, n) for n in ("activity", "counters", "ckpt"))
    whole = spark.range(6000).select((F.col("id") * 7 % 900).alias("user_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id)").alias("ts"),
                                     F.when(F.col("id") % 3 == 0, "evaluation").otherwise("visit").alias("kind"))
    for part in range(3):
        whole.filter(F.floor(F.col("id") / 2000) == part).coalesce(1).write.mode("append").parquet(path)
    q = ST.user_counter_stream(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(path), sink, ckpt)
    q.awaitTermination()
    assert len(q.recentProgress) >= 3 and all(not p["stateOperators"] for p in q.recentProgress)
    want = {r["user_id"]: tuple(r)[1:] for r in whole.groupBy("user_id").agg(
        F.min("ts"), F.max("ts"), F.count_if(F.col("kind") == "visit"), F.count_if(F.col("kind") == "evaluation")).collect()}
    def got():
        return {r["user_id"]: (r["first_seen"], r["last_seen"], r["visits"], r["evaluations"]) for r in read_activity(spark, sink).collect()}
    assert got() == want
    count_activity(spark, sink, whole, 2)  # the last batch again
    assert got() == want
