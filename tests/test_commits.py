"""The commit log: snapshots, conflicts, transactions seen whole, appends that write their rows only."""

import os
import threading
import uuid

import pytest

from tessera import commits
from tessera.catalog import Catalog
from tessera.storage import new_path


@pytest.fixture
def root(spark):
    return new_path(spark)


def tags(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, canonical_name string")


def ids(df):
    return sorted(r.id for r in df.collect())


def files(root):
    return {f"{d}/{f}" for d, _, names in os.walk(root.removeprefix("file:")) for f in names if f.endswith(".parquet")}


def test_an_append_writes_its_own_rows(spark, root):
    c = Catalog(spark, root)
    c.append("tags", tags(spark, *range(100)).coalesce(1))
    before = files(root)
    c.append("tags", tags(spark, 200).coalesce(1))
    assert before < files(root) and len(files(root)) == len(before) + 1
    assert ids(c.read("tags")) == [*range(100), 200]


def test_snapshots_stay_readable(spark, root):
    c = Catalog(spark, root)
    c.append("tags", tags(spark, 1))
    first, old = c.version("tags"), c.read("tags")
    c.write("tags", tags(spark, 2, 3))
    assert (ids(old), ids(c.read("tags", first)), ids(c.read("tags"))) == ([1], [1], [2, 3])
    with pytest.raises(ValueError, match="no commit 99"):
        c.read("tags", 99)


def test_a_transaction_is_seen_whole(spark, root):
    c, reader = Catalog(spark, root), Catalog(spark, root)
    with c.transaction():
        c.write("tags", tags(spark, 1))
        c.append("tags", tags(spark, 2))
        c.append("topics", spark.createDataFrame([(7,)], "id long"))
        assert ids(c.read("tags")) == [1, 2] and ids(c.read("topics")) == [7]
        assert ids(reader.read("tags")) == ids(reader.read("topics")) == []
    assert ids(reader.read("tags")) == [1, 2] and ids(reader.read("topics")) == [7]
    assert reader.version("tags") == reader.version("topics") == 1


def test_a_failed_transaction_leaves_nothing(spark, root):
    c = Catalog(spark, root)
    c.append("tags", tags(spark, 1))
    before = files(root)
    with pytest.raises(KeyError), c.transaction():
        c.write("tags", tags(spark, 2))
        raise KeyError
    assert files(root) == before and ids(c.read("tags")) == [1]
    c.write("tags", tags(spark, 3))
    assert ids(c.read("tags")) == [3]


def test_writers_that_read_the_same_table_conflict(spark, root):
    a, b = Catalog(spark, root), Catalog(spark, root)
    a.append("tags", tags(spark, 1))
    a.read("tags"), b.read("tags")
    a.write("tags", tags(spark, 2))
    with pytest.raises(commits.Conflict, match="tags"):
        b.write("tags", tags(spark, 3))
    assert ids(b.read("tags")) == [2]
    b.write("tags", tags(spark, 3))
    a.append("tags", tags(spark, 4))  # adds to what is there, whatever it read
    assert ids(a.read("tags")) == [3, 4]


def test_a_transaction_conflicts_with_what_it_only_read(spark, root):
    a, b = Catalog(spark, root), Catalog(spark, root)
    with pytest.raises(commits.Conflict, match="tags"), a.transaction():
        a.append("topics", spark.createDataFrame([(a.read("tags").count(),)], "id long"))
        b.append("tags", tags(spark, 1))
    assert ids(b.read("topics")) == []
    with a.transaction():  # other tables don't matter
        a.append("topics", spark.createDataFrame([(a.read("tags").count(),)], "id long"))
        b.append("methods", spark.createDataFrame([(1,)], "id long"))
    assert ids(b.read("topics")) == [1]


def test_each_number_goes_to_one_writer(spark, root):
    """Eight writers add to one key, 64 times in all; nothing is lost, also over the states in between."""
    log = commits.Log(spark, root)
    names = [[f"{w}-{i}" for i in range(8)] for w in range(8)]

    def write(own):
        for name in own:
            log.commit(log.state(), add={"k": [name]})

    threads = [threading.Thread(target=write, args=(own,)) for own in names]
    [t.start() for t in threads]
    [t.join() for t in threads]
    state = log.state()
    assert sorted(state.values["k"]) == sorted(sum(names, [])) and state.number == state.changed["k"] == len(sum(names, []))
    assert log.state(5).values["k"] == state.values["k"][:5]


def test_exclusive_files(spark, root):
    for create in (commits.create_exclusively, lambda s, path, text: commits._renamed(s, *commits.file_system(s, path), text)):
        path = f"{root}/{uuid.uuid4().hex}"
        os.makedirs(root.removeprefix("file:"), exist_ok=True)
        assert create(spark, path, "first") and not create(spark, path, "second")
        assert open(path.removeprefix("file:")).read() == "first"
    assert not [f for f in os.listdir(root.removeprefix("file:")) if f.startswith(".") and not f.endswith(".crc")]


def test_compaction_keeps_the_rows(spark, root, monkeypatch):
    monkeypatch.setattr(Catalog, "MANY", 3)
    c = Catalog(spark, root)
    for i in range(4):
        c.append("tags", tags(spark, i))
        c.compact("tags")
    assert ids(c.read("tags")) == [0, 1, 2, 3] and len(c.paths("tags")) == 2
