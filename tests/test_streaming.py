"""Micro-batches over folders."""

import json
import os

from pyspark.sql import functions as F

from weir.streaming import pipeline


def write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as out:
        out.write("\n".join(json.dumps(r) for r in rows))


def test_merge_of_batches_keeps_the_newer(spark, tmp_path):
    page = lambda id, url, text: {"id": id, "url": url, "normalized_url": url, "content_hash": text, "text": text}
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    write(source, "a", [page(5, "u", "new"), page(1, "v", "one")])
    body = pipeline.merge_into(target, ["normalized_url"], lambda: [F.desc("id")], guard="t.id <= s.id")
    pipeline.run_available(pipeline.stream_documents(spark, source), body, str(tmp_path / "state"))
    write(source, "b", [page(3, "u", "late"), page(4, "w", "two")])
    pipeline.run_available(pipeline.stream_documents(spark, source), body, str(tmp_path / "state"))
    got = {r["normalized_url"]: r["text"] for r in spark.read.parquet(f"{target}/batch=1").collect()}
    assert got == {"u": "new", "v": "one", "w": "two"}


def test_dead_letters_and_broken_batches(spark, tmp_path):
    good = {"id": 1, "type": "site_crawled", "run": 5, "host": "a.np", "bucket": "b", "key_prefix": "k/", "documents_prefix": "d/"}
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    write(source, "a", [good, {**good, "id": 2, "run": 0}])
    pipeline.run_available(pipeline.stream_events(spark, source), pipeline.validated(target), str(tmp_path / "state"))
    assert [r["id"] for r in spark.read.parquet(f"{target}/good").collect()] == [1]
    assert [(r["id"], r["fault"]) for r in spark.read.parquet(f"{target}/dead").collect()] == [(2, "run")]
    write(source, "b", [{**good, "id": 3, "type": "other"}])
    try:
        pipeline.run_available(pipeline.stream_events(spark, source), pipeline.validated(target), str(tmp_path / "state"))
        raise AssertionError("a batch of bad events only must fail")
    except AssertionError:
        raise
    except Exception as error:
        assert "faulty" in str(error)


def test_windows_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    write(source, "a", [{"event_id": k, "ts": f"2024-01-01T00:0{k}:00Z", "event_type": "view", "value": 1.0} for k in range(6)])
    stream = pipeline.stream_events(spark, source, "event_id long, ts timestamp, event_type string, value double")
    out = []
    done = pipeline.windowed(stream).writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    done.awaitTermination()
    assert pipeline.windowed(spark.read.schema(stream.schema).json(source)).agg(F.sum("n")).first()[0] == 6


def test_pacing_of_hosts(spark, tmp_path):
    source = str(tmp_path / "in")
    write(source, "a", [{"host": "a", "url": "1", "asked": 0.0, "refused": True}, {"host": "a", "url": "2", "asked": 1.0, "refused": False}, {"host": "b", "url": "3", "asked": 2.0, "refused": False}])
    stream = pipeline.stream_events(spark, source, "host string, url string, asked double, refused boolean")
    out = []
    pipeline.paced(stream).writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["url"], r["at"]) for r in out) == [("1", 0.0), ("2", 30.0), ("3", 2.0)]


def test_repeated_events_count_once(spark, tmp_path):
    source = str(tmp_path / "in")
    write(source, "a", [{"event_id": k % 2, "ts": "2024-01-01T00:00:00Z", "event_type": "view", "value": 1.0} for k in range(6)])
    out = []
    stream = pipeline.stream_events(spark, source, "event_id long, ts timestamp, event_type string, value double")
    pipeline.deduplicated(stream).writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["event_id"] for r in out) == [0, 1]
