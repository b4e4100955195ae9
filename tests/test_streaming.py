import json

from weftline.streaming import usage as U


def test_usage_streams(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    rows = [{"timestamp": 1_700_000_000_000 + k * 60_000, "tokensUsed": 10, "tokensSaved": 30, "model": "ab"[k % 2]} for k in range(6)]
    (folder / "a.json").write_text("\n".join(map(json.dumps, rows)))
    events = U.usage_stream(spark, str(folder))
    query = U.running_usage(events).writeStream.outputMode("complete").format("memory").queryName("usage_totals").start()
    query.processAllAvailable()
    query.stop()
    assert {r["model"]: (r["n_events"], r["savings_percent"]) for r in spark.table("usage_totals").collect()} == {"a": (3, 75.0), "b": (3, 75.0)}
    query = U.windowed_usage(events).writeStream.outputMode("append").format("memory").queryName("usage_windows").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("usage_windows").columns == ["start", "end", "model", "n_events", "tokens_used"]


def test_watch_and_fold(spark, tmp_path):
    folder, seen = tmp_path / "w", []
    folder.mkdir()
    (folder / "x.ts").write_text("1")
    U.watch(spark, str(folder), lambda df: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "k")).awaitTermination(60)
    assert [p.rpartition("/")[2] for p in seen] == ["x.ts"]
    chunks = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", 5), (1, 3, None, 7)], "stream_id int, pos int, content string, usage int")
    assert [tuple(r) for r in U.fold_chunks(chunks).collect()] == [(1, "ab", 7)]
