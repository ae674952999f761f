import os

from textmill.sources.watch import ChangeReader, changes_of
from textmill.streaming import feed


def test_a_stream_keeps_an_index_in_step_with_a_tree(spark, tmp_path):
    """Every run is a restart from the checkpoint."""
    root, state, base = tmp_path / "root", str(tmp_path / "state"), "file://" + str(tmp_path / "index")
    (root / "d").mkdir(parents=True)
    (root / "a.txt").write_text("one")
    (root / "d" / "b.txt").write_text("two")
    (root / "bin").write_bytes(b"\x00x")

    def run():
        feed.follow(changes_of(spark, str(root), state, hidden=False), base, "file://" + str(tmp_path / "check"), lambda df: df.select("path", "text")).awaitTermination(120)
        return {(r.path, r.text) for r in feed.current(spark, base).collect()}

    assert run() == {("a.txt", "one"), ("d/b.txt", "two"), ("bin", None)}
    (root / "a.txt").write_text("one!")
    (root / "d" / "b.txt").unlink()
    (root / "c.txt").write_text("new")
    (root / ".hidden").write_text("h")
    assert run() == {("a.txt", "one!"), ("c.txt", "new"), ("bin", None)}
    assert run() == {("a.txt", "one!"), ("c.txt", "new"), ("bin", None)}


def test_batches_are_differences_of_kept_listings(tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a").write_text("1")
    reader = ChangeReader({"path": str(root), "state": str(tmp_path / "s")})
    rows = lambda a, b: [r for p in reader.partitions(a, b) for r in reader.read(p)]
    zero, one = reader.initialOffset(), reader.latestOffset()
    assert reader.latestOffset() == one and rows(zero, one) == [(1, "a", "add", "1")]
    (root / "a").write_text("22")
    (root / "b").write_text("x")
    two = reader.latestOffset()
    # A second reader, after a restart, gives the same batch; a file that is gone by now is a removal.
    reader = ChangeReader({"path": str(root), "state": str(tmp_path / "s")})
    assert rows(one, two) == [(2, "a", "modify", "22"), (2, "b", "add", "x")]
    (root / "b").unlink()
    assert rows(one, two)[1] == (2, "b", "remove", None) and rows(two, reader.latestOffset()) == [(3, "b", "remove", None)]
    reader.commit(two)
    assert sorted(os.listdir(tmp_path / "s")) == ["listing-2.json", "listing-3.json"]
