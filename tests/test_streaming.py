import datetime as dt
import time

from weftgraph.api import CodeGraph
from weftgraph.streaming import watch


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_debounce_and_deferred(spark):
    df = spark.createDataFrame([("u", at(s)) for s in (0, 1, 2.5, 10, 11, 60)], "k string, ts timestamp")
    bursts = watch.debounce(df, "2 seconds", ["k"])
    assert sorted((r.first_ts, r.n) for r in bursts.collect()) == [(at(0), 3), (at(10), 2), (at(60), 1)]
    fires = watch.deferred_fires(bursts, 30, ["k"])
    assert sorted(r.fires_at for r in fires.collect()) == [at(41), at(90)]


def test_watch_reindexes_after_bursts_and_embeds_at_stop(spark, tmp_path):
    folder, seen, embedded = str(tmp_path / "in"), [], []
    rows = [("r/a.py", "modify", at(0)), ("r/a.py", "modify", at(1)), ("r/node_modules/x.js", "modify", at(5)), ("r/b.py", "modify", at(100)), ("r/c.py", "modify", at(500))]
    spark.createDataFrame(rows, "path string, kind string, ts timestamp").coalesce(1).write.parquet(folder)
    w = watch.watch_events(watch.file_events(spark, folder, "10 seconds"), "r", str(tmp_path / "cp"), lambda df, b: seen.extend(r.n for r in df.collect()) or 1, embedded.append, "2 seconds", embed_after=99, available_now=True)
    w.query.awaitTermination(120)
    assert sorted(seen) == [1, 2]  # the last burst waits for a later watermark
    w.stop()
    assert len(embedded) == 1


def test_an_error_does_not_end_the_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("r/a.py", "modify", at(0)), ("r/a.py", "modify", at(99))], "path string, kind string, ts timestamp").coalesce(1).write.parquet(folder)

    def fail(df, b):
        raise RuntimeError("no")

    w = watch.watch_events(watch.file_events(spark, folder), "r", str(tmp_path / "cp"), fail, available_now=True)
    w.query.awaitTermination(120)
    assert w.query.exception() is None
    w.stop()


def test_the_timer_fires_while_the_stream_is_idle(spark, tmp_path):
    folder, embedded = str(tmp_path / "in"), []
    spark.createDataFrame([("r/a.py", "modify", at(0)), ("r/b.py", "modify", at(100))], "path string, kind string, ts timestamp").coalesce(1).write.parquet(folder)
    w = watch.watch_events(watch.file_events(spark, folder, "1 second"), "r", str(tmp_path / "cp"), lambda df, b: 1, embedded.append, "2 seconds", embed_after=0.5, available_now=True)
    w.query.awaitTermination(120)
    for _ in range(100):
        if embedded:
            break
        time.sleep(0.1)
    w.stop()
    assert len(embedded) == 1


def test_a_tree_is_watched_across_restarts(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def first():\n    return 1\n")
    g = CodeGraph(spark, str(root), str(tmp_path / "store"))
    run = lambda: watch.watch_tree(g, str(tmp_path / "cp"), embed_after=99, available_now=True)
    w = run()
    w.query.awaitTermination(120)
    w.stop()
    assert [r.name for r in g.store.read("symbols").collect()] == ["first"]
    (root / "b.py").write_text("def second():\n    return first()\n")
    (root / "a.py").unlink()
    w = run()
    w.query.awaitTermination(120)
    w.stop()
    assert [r.name for r in g.store.read("symbols").collect()] == ["second"]
