"""Membership edits that commit by compare-and-swap."""

from quarry.operators import commits

EDIT = "draft_id string, expected_revision long, sample_id string, split string"


def table(spark, tmp_path, buckets=3):
    return commits.Versioned(spark, str(tmp_path / "m"), commits.MEMBERSHIP, "draft_id", buckets)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_edits_close_and_open_intervals(spark, tmp_path):
    m = table(spark, tmp_path)
    put = lambda *edits: rows(commits.apply_edits(m, spark.createDataFrame(edits, EDIT)))
    assert put(("a", 0, "s1", "train"), ("a", 0, "s2", "test"), ("b", 0, "s1", "train"), ("c", 1, "s1", "train"), ("e", 0, "s1", "x"), ("e", 0, "s1", "y"), (None, 0, "s", "x")) == [("a", "applied", 1), ("b", "applied", 1), ("c", "stale", 0), ("e", "repeated", 0)]
    assert put(("a", 1, "s1", "test"), ("a", 1, "s2", "test"), ("a", 1, "s9", None), ("b", 0, "s1", None)) == [("a", "applied", 2), ("b", "stale", 1)]
    assert put(("a", 2, "s1", None), ("a", 2, "s2", None), ("b", 1, "s2", "test")) == [("a", "applied", 3), ("b", "applied", 2)]
    assert put(("a", 3, "s1", "train"), ("a", 4, "s3", "train")) == [("a", "repeated", 3)]
    assert put(("a", None, "s1", "train")) == [("a", "stale", 3)] and put() == []
    members = lambda v: rows(commits.members_of(m.read(v)))
    assert members(3) == sorted([("a", "s1", "train", 1, 2), ("a", "s1", "test", 2, 3), ("a", "s2", "test", 1, 3), ("b", "s1", "train", 1, None), ("b", "s2", "test", 2, None)], key=str)
    assert members(1) == sorted([("a", "s1", "train", 1, None), ("a", "s2", "test", 1, None), ("b", "s1", "train", 1, None)], key=str)  # versions stay
    assert m.version() == 3 and rows(commits.drafts_of(m.read())) == [("a", 3), ("b", 2)]


def test_one_of_two_commits_gets_through(spark, tmp_path, monkeypatch):
    m = table(spark, tmp_path)
    edit = lambda split, expected: spark.createDataFrame([("a", expected, "s", split)], EDIT)
    commits.apply_edits(m, edit("train", 0))
    # A second writer read the version that the first one then replaced.
    monkeypatch.setattr(m, "version", lambda: 0)
    assert rows(commits.apply_edits(m, edit("test", 0))) == [("a", "raced", 1)]
    monkeypatch.undo()
    assert m.version() == 1 and rows(commits.members_of(m.read())) == [("a", "s", "train", 1, None)]
    assert rows(commits.apply_edits(m, edit("test", 0))) == [("a", "stale", 1)]
    assert rows(commits.apply_edits(m, edit("test", 1))) == [("a", "applied", 2)]
    assert len(list((tmp_path / "m/rows").iterdir())) == 2  # the overtaken writer's rows are gone
