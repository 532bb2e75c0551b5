import datetime as dt

from scanloom.streaming import flights

SHAPE = "flight_id long, ts timestamp, mission_state int, waypoint_index int, is_action boolean"


def events():
    t0 = dt.datetime(2026, 6, 12, 10)
    rows = []
    for f in (1, 2):
        for k in range(30):
            t = t0 + dt.timedelta(seconds=20 * k + (1200 if k >= 15 else 0) + f)
            rows.append((f, t, (16, 32, 48)[k // 10], k, k % 2 == 0))
    return rows


def run(spark, tmp_path, build, mode, name):
    for i in range(3):
        part = [r for k, r in enumerate(sorted(events(), key=lambda r: r[1])) if k // 20 == i]
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    last = dt.datetime(2026, 6, 13)
    spark.createDataFrame([(9, last, 0, 0, True)], SHAPE).coalesce(1).write.parquet(f"{tmp_path}/in3")
    spark.createDataFrame([(9, last + dt.timedelta(hours=1), 0, 0, True)], SHAPE).coalesce(1).write.parquet(f"{tmp_path}/in4")
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}-state-{name}").trigger(availableNow=True).start()
    q.awaitTermination(180)
    q.stop()
    return spark.table(name)


def test_windows_equal_their_batch_twin(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: flights.action_rate(s, "1 minute"), "append", "rates").where("window_end < '2026-06-13'")
    want = flights.action_rate(spark.createDataFrame(events(), SHAPE), "1 minute")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    report = flights.rate_report(want).first()
    assert report.peak >= report.sustained > 0


def test_sessions_equal_their_batch_twin(spark, tmp_path):
    got = run(spark, tmp_path, flights.sessions, "append", "runs").where("flight_id <> 9")
    want = flights.sessions(spark.createDataFrame(events(), SHAPE))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 4


def test_states_equal_their_batch_twin(spark, tmp_path):
    got = run(spark, tmp_path, flights.state_intervals, "append", "states").where("flight_id <> 9")
    want = flights.state_intervals_batch(spark.createDataFrame(events(), SHAPE))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
