from pyspark.sql import functions as F

from textmill.control import Index, cancellable


def scan(spark, files):
    rows = spark.createDataFrame(list(files.items()), "path string, text string")
    return lambda: rows.select("path", "text", F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), F.md5("text").alias("hash"))


def state(s):
    return sorted((r.path, r.name) for r in s.tables["symbols"].collect()), sorted((r.src, r.dst) for r in s.tables["edges"].collect())


def test_incremental_equals_rebuild(spark):
    one = {"a.py": "def f(): pass\nfrom . import b\n", "b.py": "X = 1\n", "c.md": "# T\n"}
    two = {"a.py": "def g(): pass\nfrom . import b\n", "c.md": "# T\n", "d.ts": 'import "./e"', "e.ts": "class K {}"}
    index = Index(spark)
    first = index.get(("r",), scan(spark, one))
    assert index.get(("r",), scan(spark, two), max_stale_ms=10**6) is first
    second = index.get(("r",), scan(spark, two))
    assert state(second) == state(Index(spark).get(("x",), scan(spark, two))) and second.revision > first.revision
    assert ("d.ts", "e.ts") in state(second)[1] and ("a.py", "g") in state(second)[0]
    assert index.since(first.revision) == ["a.py", "b.py", "d.ts", "e.ts"]
    assert index.invalidate("nothing")["snapshots"] == 0 and index.since(index.revision - 1) == ["nothing"] and index.since(0) is None
    assert index.invalidate("e.ts")["snapshots"] == 1 and index.clear()["snapshots"] == 0
    assert index.profile().where("name = 'sweep'").head()["count"] == 2


def test_cancelling(spark):
    import threading
    import time

    with cancellable(spark, "slow") as cancel:
        threading.Timer(1.5, cancel).start()
        began = time.time()
        try:
            spark.range(0, 4, 1, 4).mapInPandas(lambda it: (time.sleep(60) or x for x in it), "id long").count()
        except Exception:  # noqa: BLE001
            pass
        assert time.time() - began < 40
