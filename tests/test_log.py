import shutil

import pytest
from pyspark.sql import Window as W, functions as F

from contrail.streaming import log, topics

SF = "/root/testdata/sf0.001"


def messages(spark, keep="true"):
    return topics.landed(spark, SF).filter(keep)


def test_offsets_are_dense_and_follow_time(spark, tmp_path):
    root = f"{tmp_path}/log"
    early = F.pmod(F.xxhash64("payload"), F.lit(2)) == 0
    log.publish(messages(spark).filter(early), root, segment_rows=300)
    log.publish(messages(spark).filter(~early), root, segment_rows=300)
    held = log.read_log(spark, root)
    place = W.partitionBy("topic", "partition")
    gaps = held.withColumn("n", F.row_number().over(place.orderBy("offset")) - 1).filter("n <> offset").count()
    assert gaps == 0 and held.count() == messages(spark).count()
    columns = ["topic", "partition", "key", "event_time", "payload"]
    assert held.select(columns).exceptAll(messages(spark).select(columns)).count() == 0
    # inside one landing the messages of a key keep their order
    first = log.read_log(spark, root).join(messages(spark).filter(early).select("payload", "topic"), ["payload", "topic"])
    by_key = W.partitionBy("topic", "key").orderBy("offset")
    assert first.withColumn("before", F.lag("event_time").over(by_key)).filter("before > event_time").count() == 0


def test_stream_stops_restarts_and_replays(spark, tmp_path):
    root, places = f"{tmp_path}/log", {"path": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/cp"}
    half = F.pmod(F.xxhash64("payload"), F.lit(2)) == 0
    log.publish(messages(spark).filter(half), root, segment_rows=500)
    assert topics.run_to_table(log.stream_log(spark, root), "t", **places).count() == messages(spark).filter(half).count()
    log.publish(messages(spark).filter(~half), root, segment_rows=500)
    for _ in range(2):  # the second time there is nothing new
        out = topics.run_to_table(log.stream_log(spark, root), "t", **places)
        assert out.count() == messages(spark).count() == out.select("topic", "partition", "offset").distinct().count()
    replayed = topics.run_to_table(log.stream_log(spark, root), "t", f"{tmp_path}/again", f"{tmp_path}/cp2")
    assert replayed.exceptAll(out).count() == out.exceptAll(replayed).count() == 0


def test_a_failed_batch_reads_the_same_offsets_again(spark, tmp_path):
    root = f"{tmp_path}/log"
    log.publish(messages(spark), root)
    seen = []

    def work(fails):
        def run(rows, batch):
            seen.append((batch, sorted(map(tuple, rows.groupBy("topic", "partition").agg(F.min("offset"), F.max("offset")).collect()))))
            if fails:
                raise RuntimeError("lost")

        return run

    def start(fails):
        stream = log.stream_log(spark, root).writeStream.foreachBatch(work(fails))
        return stream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()

    with pytest.raises(Exception):
        start(True).awaitTermination()
    log.publish(messages(spark), root)  # what lands in between belongs to the next batch
    for _ in range(2):
        start(False).awaitTermination()
    assert seen[0] == seen[1] and [batch for batch, _ in seen] == [0, 0, 1]


def test_topics_and_starting_offsets(spark, tmp_path):
    root = f"{tmp_path}/log"
    log.publish(messages(spark), root)
    some = topics.run_to_table(log.stream_log(spark, root, topics="gate-event,weather-event"), "t", f"{tmp_path}/a")
    assert {r[0] for r in some.select("topic").distinct().collect()} == {"gate-event", "weather-event"}
    places = {"path": f"{tmp_path}/b", "checkpoint": f"{tmp_path}/b-cp"}
    assert topics.run_to_table(log.stream_log(spark, root, startingOffsets="latest"), "t", **places).count() == 0
    log.publish(messages(spark, "topic = 'gate-event'"), root)
    new = topics.run_to_table(log.stream_log(spark, root, startingOffsets="latest"), "t", **places)
    assert new.count() == messages(spark, "topic = 'gate-event'").count()


def test_missing_segments(spark, tmp_path):
    root = f"{tmp_path}/log"
    log.publish(messages(spark, "topic = 'gate-event'"), root, segment_rows=100)
    files = log.LogFiles(root)
    first, reach = files.bounds()
    # a hole: only what stands before it can be read
    shutil.move(f"{root}/topic=gate-event/partition=0/segment=1", f"{tmp_path}/gone")
    assert files.bounds()[1]["gate-event"]["0"] == 100 and files.bounds()[1]["gate-event"]["1"] == reach["gate-event"]["1"]
    with pytest.raises(ValueError, match="no longer"):
        files.between(first, reach, lossy=False)
    assert sum(s.stop - s.first for s in files.between(first, reach, lossy=True)) == sum(reach["gate-event"].values()) - 100
    assert log.LogFiles(f"{tmp_path}/none").bounds() == ({}, {})


def test_payloads_made_when_written_are_the_same_messages(spark, tmp_path):
    early = F.pmod(F.xxhash64("event_time", "key"), F.lit(2)) == 0
    for part in (early, ~early):
        log.publish(topics.landed_rows(spark, SF).filter(part), f"{tmp_path}/log", segment_rows=300, payload=topics.payload())
    held = log.read_log(spark, f"{tmp_path}/log")
    columns = ["topic", "partition", "key", "event_time", "payload"]
    wanted = messages(spark).select(columns)
    assert held.count() == wanted.count() and held.select(columns).exceptAll(wanted).count() == 0
    place = W.partitionBy("topic", "partition").orderBy("offset")
    first = held.withColumn("n", F.row_number().over(place) - 1)
    assert first.filter("n <> offset").count() == 0
    sizes = spark.read.parquet(f"{tmp_path}/log").groupBy(F.input_file_name()).count()
    assert sizes.agg(F.max("count")).first()[0] <= 300


def test_payloads_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(value):
        made.add(1)
        return f"<{value}>"

    rows = spark.range(500).selectExpr("'t' AS topic", "0 AS partition", "'k' AS key", "timestamp_seconds(id) AS event_time", "id AS v")
    log.publish(rows, f"{tmp_path}/log", segment_rows=100, payload=text("v"))
    assert made.value == 500
    held = log.read_log(spark, f"{tmp_path}/log").orderBy("offset").collect()
    assert [r["payload"] for r in held] == [f"<{i}>" for i in range(500)]
