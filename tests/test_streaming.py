import json

import pytest
from pyspark.sql import functions as F

from textmill.errors import CorpusError
from textmill.sources import shell
from textmill.streaming import chunks as ch
from textmill.streaming import feed


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("revision", "path", "event", "text"), r, strict=True))) for r in rows))


@pytest.mark.parametrize("compact_every", [1, 2, 20])
def test_feed_keeps_an_index_in_step(spark, tmp_path, compact_every):
    src, base, cp = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "cp")
    parse = lambda df: df.select("path", F.size(F.split("text", " ")).alias("words"))
    steps = [[(1, "a", "create", "x y"), (2, "b", "create", "x"), (3, "a", "modify", "x y z")], [(4, "b", "remove", None), (5, "c", "create", "q")], [(6, "a", "remove", None), (7, "b", "create", "x y")], [(8, "a", "create", "z")]]
    want = [{"a": 3, "b": 1}, {"a": 3, "c": 1}, {"b": 2, "c": 1}, {"a": 1, "b": 2, "c": 1}]
    for k, rows in enumerate(steps):
        put(src, f"{k}.json", rows)
        feed.follow(feed.changes(spark, str(src)), base, cp, parse, compact_every).awaitTermination()
        assert {r.path: r.words for r in feed.current(spark, base).collect()} == want[k]
    assert {r.path: r.words for r in feed.current(spark, base, 1).collect()} == want[1]


def test_windowed_counts_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:0{m}:00", "k": "x"}) for m in (0, 1, 2, 7)))
    s = spark.readStream.schema("ts timestamp, k string").json(str(tmp_path / "in"))
    q = feed.windowed_counts(s, "ts", "k", "5 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.sql("select n from counts").collect()) == [1, 3]


def test_log_and_effects(spark):
    log = spark.createDataFrame([(k, f"p{k}") for k in range(1, 21)], "revision long, path string")
    assert [r.revision for r in ch.since(log, 17, ring=10).orderBy("revision").collect()] == [18, 19, 20]
    assert [tuple(r) for r in ch.since(log, 3, ring=10).collect()] == [(20, None)]
    assert ch.since(log, 10, ring=10).count() == 10 and ch.since(log, 20, ring=10).count() == 0
    e = {r.event: (r.drops_content, r.drops_walk, r.recorded) for r in ch.effects(spark.createDataFrame([("modify",), ("access",), ("new",)], "event string")).collect()}
    assert e == {"modify": (True, False, True), "access": (False, False, False), "new": (True, True, True)}


def test_chunks_sessions_profile(spark):
    c = spark.createDataFrame([("a", 2, "c"), ("a", 0, "a"), ("a", 1, "b")], "k string, seq long, text string")
    assert [tuple(r) for r in ch.reassemble(c, ["k"], "seq").collect()] == [("a", "abc", 3)]
    p = ch.profile(spark.createDataFrame([("n", v) for v in [1] * 98 + [1000, 5000]], "name string, us long")).head()
    assert (p["count"], p.min_us, p.max_us, p.p50_us, p.p99_us) == (100, 1, 5000, 2, 1024)


def test_commands():
    with pytest.raises(CorpusError):
        shell.run("true")
    r = shell.run("printf 'é1'; printf err >&2; exit 3", allow=True)
    assert (r.stdout, r.stderr, r.exit_code) == ("é1", "err", 3) and [c[0] for c in r.chunks] == list(range(len(r.chunks)))
    r = shell.run("sleep 30", timeout_ms=200, allow=True)
    assert r.timed_out and r.signal == 9 and r.exit_code is None
    assert shell.run("echo $X", env=[("X", "y")], env_clear=True, allow=True).stdout == "y\n"


def test_a_stateful_sweep_gives_the_batch_result(spark, tmp_path):
    """Shuffled and repeated events, batch by batch, with a restart in the middle."""
    import json
    import random


    r = random.Random(4)
    events = [(rev, f"p{r.randrange(6)}", r.choice(["add", "modify", "modify", "remove"]), f"h{r.randrange(3)}") for rev in range(60)]
    newest = {}
    for e in events:
        newest[e[1]] = e
    sent = events + r.sample(events, 20)
    r.shuffle(sent)
    folder, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    folder.mkdir()

    def run(part, n):
        for k in range(0, len(part), 16):
            (folder / f"{n}-{k:03}.json").write_text("\n".join(json.dumps(dict(zip(("revision", "path", "event", "hash"), e, strict=True))) for e in part[k : k + 16]))
        stream = spark.readStream.schema("revision long, path string, event string, hash string").option("maxFilesPerTrigger", 1).json(str(folder))
        feed.swept(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).outputMode("append").trigger(availableNow=True).start().awaitTermination(300)

    run(sent[:40], 0)
    run(sent[40:], 1)
    got = {}
    for row in spark.read.parquet(str(out)).orderBy("revision").collect():
        got[row.path] = row
    for path, (rev, _, event, h) in newest.items():
        if event == "remove":
            assert path not in got or got[path].change == "removed" and got[path].revision == rev or got[path].revision < rev
            assert path not in got or got[path].change == "removed"
        else:
            assert (got[path].revision, got[path].hash) == (rev, h) and got[path].change in ("added", "modified", "touched")
