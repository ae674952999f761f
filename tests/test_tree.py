import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textmill.errors import CorpusError
from textmill.sources import tree as tr
from textmill.sources import walk as wk


@pytest.fixture
def root(tmp_path):
    for name in ["a/x.txt", "a/b/y.txt", "a/b/c/z.txt", "d/big.bin", ".git/config", ".git/objects/o", "skip/s.txt", "e.txt"]:
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"0" * (5000 if "big" in name else len(name)))
    (tmp_path / "root" / ".ignore").write_text("skip/**\n")
    return tmp_path / "root"


def touched(root, filters, monkeypatch, **options):
    """Folders that a reader lists and files that it reads under pushed filters."""
    from pyspark.sql import datasource as ds

    listed, read, real_list, real_open = set(), set(), os.listdir, open
    monkeypatch.setattr(os, "listdir", lambda p: listed.add(os.path.relpath(p, root)) or real_list(p))
    monkeypatch.setattr("builtins.open", lambda p, *a, **k: (read.add(os.path.relpath(p, root)) if str(p).startswith(str(root)) else None) or real_open(p, *a, **k))
    reader = tr.PrunedTreeReader({"path": str(root), **options})
    assert len(list(reader.pushFilters([getattr(ds, k)(*a) for k, *a in filters]))) == len(filters)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    monkeypatch.undo()
    return {r[1] for r in rows}, listed, read - {".ignore", ".rgignore"}


def test_filters_prune_the_listing_and_the_reading(root, monkeypatch):
    rows, listed, read = touched(root, [("StringStartsWith", ("rel_path",), "a/b/")], monkeypatch)
    assert rows == {"a/b/y.txt", "a/b/c", "a/b/c/z.txt"} and listed == {".", "a", "a/b", "a/b/c"} and read == {"a/b/y.txt", "a/b/c/z.txt"}
    rows, listed, read = touched(root, [("EqualTo", ("is_hidden",), False), ("EqualTo", ("kind",), "file"), ("LessThan", ("size",), 100)], monkeypatch)
    assert rows == {"a/x.txt", "a/b/y.txt", "a/b/c/z.txt", "e.txt"} and ".git" not in listed and "d/big.bin" not in read
    rows, listed, read = touched(root, [("In", ("rel_path",), ("e.txt", "a/x.txt"))], monkeypatch)
    assert rows == {"e.txt", "a/x.txt"} and listed == {".", "a"} and read == rows
    rows, listed, read = touched(root, [("GreaterThan", ("size",), 4999)], monkeypatch)
    assert rows == {"d/big.bin"} == read


def test_pushed_filters_give_what_spark_gives(spark, root):
    every = tr.tree(spark, str(root)).collect()
    names = lambda df: sorted(r.rel_path for r in df.collect())
    for cond, keep in [
        (F.startswith("rel_path", F.lit("a/")) & (F.col("kind") == "file"), lambda r: r.rel_path.startswith("a/") and r.kind == "file"),
        (~F.col("is_hidden") & (F.col("size") > 8), lambda r: not r.is_hidden and r.size > 8),
        (F.col("rel_path").isin("e.txt", "none"), lambda r: r.rel_path == "e.txt"),
        ((F.col("size") >= 5000) | (F.col("name") == "e.txt"), lambda r: r.size >= 5000 or r.name == "e.txt"),
    ]:
        df = tr.pruned(spark, str(root), cond)
        assert names(df) == sorted(r.rel_path for r in every if keep(r))
        # What is asked of the result later, or with nothing more to push, is right as well.
        assert names(df.where("size > 8")) == sorted(r.rel_path for r in every if keep(r) and r.size > 8)
        assert df.count() == sum(map(keep, every))
    assert len(every) == tr.tree(spark, str(root)).count()
    assert [r.path for r in tr.files(spark, str(root), F.col("rel_path") == "a/x.txt").collect()] == ["a/x.txt"]


def entries(df):
    return {(r.rel_path, r.kind) for r in df.collect()}


def test_links_and_cycles(spark, root, monkeypatch):
    os.symlink("..", root / "a" / "up")
    os.symlink("b", root / "a" / "again")
    os.symlink("e.txt", root / "f")
    os.symlink("nowhere", root / "gone")
    plain = {("a", "dir"), ("a/x.txt", "file"), ("a/b", "dir"), ("a/b/y.txt", "file"), ("a/b/c", "dir"), ("a/b/c/z.txt", "file"), ("d", "dir"), ("d/big.bin", "file"), ("e.txt", "file"), ("skip", "dir"), ("gone", "symlink")}
    links = {("a/up", "symlink"), ("a/again", "symlink"), ("f", "symlink")}
    assert entries(wk.walk(spark, str(root), hidden=False)) == plain | links
    # The folder that two paths lead to is entered by the lesser one of its level; the cycle is listed once.
    inside = {(p.replace("a/b/", "a/again/"), k) for p, k in plain if p.startswith("a/b/")}
    followed = {("a/up", "dir"), ("a/again", "dir"), ("f", "file")}
    for tasks in (1, 64):
        monkeypatch.setattr(wk, "TASKS", tasks)
        got = wk.walk(spark, "file://" + str(root), hidden=False, follow_symlinks=True)
        assert entries(got) == {(p, k) for p, k in plain if not p.startswith("a/b/")} | followed | inside
    read = {r.path: r.content for r in wk.contents(got, str(root), 100).collect()}
    assert read["f"] == b"0" * len("e.txt") and read["d/big.bin"] is None


def test_the_budget_is_of_the_whole_tree(spark, root, monkeypatch):
    every = wk.walk(spark, str(root), respect_ignore=False)
    n, size = every.count(), sum(len(r.rel_path.encode()) for r in every.collect())
    for tasks in (1, 32):
        monkeypatch.setattr(wk, "TASKS", tasks)
        assert wk.walk(spark, str(root), respect_ignore=False, most_entries=n, most_path_bytes=size).count() == n
        for k in ({"most_entries": n - 1}, {"most_path_bytes": size - 1}):
            with pytest.raises(CorpusError, match="too large"):
                wk.walk(spark, str(root), respect_ignore=False, **k)
    with pytest.raises(CorpusError, match="no such folder"):
        wk.walk(spark, str(root / "none"))


def test_names_that_are_no_text(spark, tmp_path):
    os.makedirs(os.fsencode(tmp_path) + b"/r/bad\xff")
    Path(os.fsdecode(os.fsencode(tmp_path) + b"/r/bad\xff/in.txt")).write_text("q")
    got = wk.walk(spark, str(tmp_path / "r"))
    assert entries(got) == {("bad�", "dir"), ("bad�/in.txt", "file")}
    assert [bytes(r.content) for r in wk.contents(got, str(tmp_path / "r")).collect()] == [b"q"]
    os.makedirs(tmp_path / "empty")
    assert wk.walk(spark, str(tmp_path / "empty")).count() == 0
