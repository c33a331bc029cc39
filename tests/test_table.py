"""Tables: snapshots, writes, indexes, transactions, compaction, administration."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from vtable.sources.log import Commit, CorruptTable, DataFile, SlotTaken
from vtable.sources.options import Options, parse_string
from vtable.sources.schema import SchemaError, TableSchema, parse_ddl
from vtable.table import ConflictError, Expired, Table, UniqueViolation, apart, beneath
from vtable.txn import commit_all


@pytest.fixture
def path(tmp_path):
    return f"{tmp_path}/t"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_typed_rows(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, name TEXT, age REAL")
    t.insert([(1, "Alice", 30.5), (2, "Bob", 40.0)])
    assert t.get(1) == {"id": 1, "name": "Alice", "age": 30.5}
    assert [r.id for r in t.ordered().collect()] == [1, 2]
    before = t.version
    t.update("id = 1", {"name": "Alice Cooper"})
    t.delete("id = 2")
    assert t.get(1)["name"] == "Alice Cooper" and t.count() == 1 and t.get(2) is None
    assert t.get(1, as_of=before)["name"] == "Alice" and t.read(before).count() == 2
    assert Table.open(spark, path).get(1)["name"] == "Alice Cooper"


def test_key_order_and_null_values(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, x REAL, s TEXT, INDEX(x)")
    t.insert([(i, i * 1.25, None) for i in (-2, -1, 0, 1, 2)])
    assert [r.id for r in t.range(-1, 1).orderBy("id").collect()] == [-1, 0, 1]
    assert [r.id for r in t.lookup_range(t.schema.indexes[0].name).collect()] == [-2, -1, 0, 1, 2]
    assert t.get(0)["s"] is None
    assert [r.id for r in t.seek(0, 2).collect()] == [0, 1]
    assert rows(t.multi_get([2, -2, 7]).select("id")) == [(-2,), (2,)]
    with pytest.raises(SchemaError):
        t.insert([(None, 1.0, "a")])
    with pytest.raises(SchemaError):
        t.insert([(1, 1.0, "a"), (1, 2.0, "b")])


def test_index_maintenance(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, email TEXT, INDEX(email)")
    t.insert([(1, "alice"), (2, "bob"), (3, "charlie")])
    t.update("id = 2", {"email": "bob.new"})
    t.delete("id = 1")
    name = t.schema.indexes[0].name
    assert t.get(2)["email"] == "bob.new" and t.count() == 2
    assert rows(t.index(name)) == [("bob.new", 2), ("charlie", 3)]
    t.insert([(3, "dora")])  # over an existing key: the old entry goes
    assert rows(t.lookup(name, "charlie")) == [] and rows(t.lookup(name, "dora")) == [(3, "dora")]
    assert {r.check: r.problems for r in t.check().collect()} == {"files": 0, "row_counts": 0, "key_versions": 0, f"{name}_missing": 0, f"{name}_extra": 0}


def test_composite_index_prefix(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, a TEXT, b INT, INDEX(a, b)")
    t.insert([(1, "a", -1), (2, "a\0b", 5), (3, "a", 2)])
    name = t.schema.indexes[0].name
    assert rows(t.lookup(name, "a").select("id")) == [(1,), (3,)]
    assert rows(t.lookup(name, "a", -1).select("id")) == [(1,)]
    assert rows(t.where(a="a", b=2).select("id")) == [(3,)] and rows(t.where(id=2).select("a")) == [("a\0b",)]


def test_unique(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, email TEXT UNIQUE")
    t.insert([(1, "a"), (2, "b"), (3, None), (4, None)])
    with pytest.raises(UniqueViolation):
        t.insert([(5, "a")])
    with pytest.raises(UniqueViolation):
        t.insert([(5, "c"), (6, "c")])
    t.insert([(1, "a")])  # its own value
    t.delete("id = 1")
    t.insert([(5, "a")])  # a deleted row's value is free
    t.write(t.frame([(5, "b"), (2, "a")]))  # swapped in one commit
    assert rows(t.read()) == [(2, "a"), (3, None), (4, None), (5, "b")]


def test_insert_modes_and_key_change(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, v TEXT")
    t.insert([(1, "a"), (2, "b")])
    with pytest.raises(UniqueViolation):
        t.insert([(1, "x")], mode="error")
    t.insert([(1, "x"), (3, "c")], mode="ignore")
    assert rows(t.read()) == [(1, "a"), (2, "b"), (3, "c")]
    t.update("id >= 2", {"id": F.col("id") + 1})
    assert rows(t.read()) == [(1, "a"), (3, "b"), (4, "c")]


def test_savepoints_and_own_writes(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, name TEXT, INDEX(name)")
    t.insert([(1, "Alice")])
    x = t.begin()
    x.insert([(2, "Bob")])
    x.savepoint("sp1")
    x.insert([(3, "Charlie")])
    x.update("id = 1", {"name": "Alice 2"})
    assert x.get(1)["name"] == "Alice 2" and x.lookup(t.schema.indexes[0].name, "Charlie").count() == 1
    assert x.lookup(t.schema.indexes[0].name, "Alice").count() == 0
    x.savepoint("sp2")
    x.delete("id = 2")
    x.rollback_to("sp1")
    assert rows(x.read()) == [(1, "Alice"), (2, "Bob")] and t.count() == 1
    with pytest.raises(KeyError):
        x.rollback_to("sp2")
    x.commit()
    assert rows(t.read()) == [(1, "Alice"), (2, "Bob")]


def test_conflicts(spark, path):
    t = Table.create(spark, path, "k TEXT PRIMARY KEY, v TEXT")
    t.insert([("A", "1")])
    a, b, c = t.begin(), t.begin(), t.begin()
    a.put([("A", "2")])
    b.put([("A", "3")])
    c.put([("B", "4")])
    assert b.get("A")["v"] == "3" and c.get("A")["v"] == "1"
    got = commit_all([a, b, c])
    assert isinstance(got[1], ConflictError) and got[0] < got[2]
    assert rows(t.read()) == [("A", "2"), ("B", "4")]


def test_unique_race(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, email TEXT UNIQUE")
    a, b = t.begin(), t.begin()
    a.put([(1, "x")])
    b.put([(2, "x")])
    a.commit()
    with pytest.raises(UniqueViolation):
        b.commit()


def test_two_writers(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, v INT")
    done = []

    def write(k):
        try:
            done.append(Table(spark, path).insert([(k, k), (100 + k, k)]))
        except ConflictError as e:
            done.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert len({d for d in done if isinstance(d, int)}) == 4 and t.count() == 8


def test_crash_leaves_nothing(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, v INT")
    t.insert([(1, 1)])
    t._save(t._shape(t.frame([(2, 2)])), "data/orphan", ["id"])
    assert rows(Table(spark, path).read()) == [(1, 1)]
    assert t.vacuum() == ["data/orphan"] and t.count() == 1
    with open(t.store.local_path(f"_log/{3:020d}.json"), "w") as f:
        f.write('{"version": 3, "op"')
    with pytest.raises(CorruptTable):
        Table(spark, path)


@pytest.mark.parametrize("seed", range(2))
def test_model(spark, path, seed):
    """Random writes, transactions and compactions against dictionaries; every kept snapshot must agree."""
    r = random.Random(seed)
    t = Table.create(spark, path, "id INT PRIMARY KEY, v INT, INDEX(v)", options=Options(l0_limit=3, retain=3))
    now, seen = {}, {}
    for _ in range(12):
        kind = r.choice(["put", "put", "delete", "txn", "compact"])
        if kind == "put":
            new = {r.randrange(8): r.randrange(100) for _ in range(3)}
            t.insert(list(new.items()))
            now |= new
        elif kind == "delete":
            k = r.randrange(8)
            t.delete_keys([k])
            now.pop(k, None)
        elif kind == "txn":
            x, a, b = t.begin(), r.randrange(8), r.randrange(8)
            x.put([(a, 1000)])
            x.savepoint("s")
            x.delete_keys([b])
            if r.random() < 0.5:
                x.rollback_to("s")
            x.commit()
            now[a] = 1000
            if x._ops == [] and t.get(b) is None:
                now.pop(b, None)
        else:
            t.compact(everything=r.random() < 0.5)
        seen[t.version] = dict(now)
    for v, want in seen.items():
        try:
            got = dict(rows(t.read(v)))
        except Expired:
            assert v < t.log.head().horizon
            continue
        assert got == want, v
    assert all(x.problems == 0 for x in t.check().collect())


def test_compaction(spark, path):
    t = Table.create(spark, path, "k TEXT PRIMARY KEY, v INT")
    for v in (1, 2, 3):
        t.insert([("a", v), (f"b{v}", v)])
    t.delete("k = 'b1'")
    want = rows(t.read())
    with t.pinned():
        t.insert([("a", 9)])
        t.compact(everything=True)
        assert rows(t.read(t.threshold())) == want
    t.compact(everything=True)
    plan = t.read()._jdf.queryExecution().toString()
    assert "max_by" not in plan and rows(t.read()) == [("a", 9), ("b2", 2), ("b3", 3)]
    t.vacuum()
    with pytest.raises(Expired):
        t.read(2)
    t.insert([("a", 10)])
    assert t.get("a")["v"] == 10


def test_tombstone_outlives_a_partial_compaction(spark, path):
    t = Table.create(spark, path, "k TEXT PRIMARY KEY, v INT", options=Options(l0_limit=1))
    t.insert([("a", 1)])
    t.compact()
    t.compact(everything=True)
    t.delete("k = 'a'")
    t.compact()
    assert t.count() == 0


def test_evolution(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY")
    t.insert([(1,)])
    t.add_column("name", "TEXT")
    t.insert([(2, "b")])
    u = Table.open(spark, path, "id INT PRIMARY KEY, extra REAL, gone NULL")
    assert rows(u.read()) == [(1, None, None, None), (2, "b", None, None)]
    name = u.add_index(["name"])
    assert rows(u.lookup(name, "b").select("id")) == [(2,)]
    u.rename("other")
    assert Table(spark, path).schema.name == "other"
    with pytest.raises(SchemaError):
        u.insert([{"id": 1, "nope": 2}])


def test_backup_and_stats(spark, path, tmp_path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, name TEXT, INDEX(name)")
    t.insert([(1, "Alice"), (2, "Bob")])
    t.backup(f"{tmp_path}/copy")
    t.delete("id = 1")
    copy = Table.open(spark, f"{tmp_path}/copy")
    assert copy.get(1)["name"] == "Alice" and copy.count() == 2
    assert {(r.kind, r.level) for r in t.stats().collect()} == {("rows", 0), (t.schema.indexes[0].name, 0)}
    assert t.metrics.counts["commits"] == 2


def test_changes_and_diff(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, v INT")
    a = t.insert([(1, 1), (2, 2), (3, 3)])
    t.insert([(1, 10)])
    b = t.delete("id = 2")
    t.insert([(4, 4)])
    assert rows(t.changes(a, b)) == [(1, 10, a + 1, False), (2, 2, b, True)]
    assert rows(t.diff(a, t.version).select("id", "change")) == [(1, "update"), (2, "delete"), (4, "insert")]
    got = []
    t.follow(lambda df, v: got.append((v, df.count())))
    assert [n for _, n in got] == [3, 1, 1, 1]


def test_schema_parser():
    s = parse_ddl("t", "id int primary key, name TEXT unique, a REAL, INDEX (name, a), unique index(a)")
    assert s.key == ("id",) and [(i.name, i.columns, i.unique) for i in s.indexes] == [("uidx_t_name", ("name",), True), ("idx_t_name_a", ("name", "a"), False), ("uidx_t_a", ("a",), True)]
    assert TableSchema.from_json(s.to_json()) == s
    assert parse_ddl("t", "").key == ("key",) and parse_ddl("t", "PRIMARY KEY(a, b), a INT, b TEXT").key == ("a", "b")
    for bad in ("id INT", "id INT PRIMARY KEY, INDEX(x)", "id INT PRIMARY KEY, ???", "id INT PK, id TEXT", "_v INT PK"):
        with pytest.raises(SchemaError):
            parse_ddl("t", bad)


def test_options(tmp_path):
    (tmp_path / "c").write_text("# all\nl1_mb = 7\nl0_limit=9 # nine\n")
    o = Options().with_(parse_string(f"l0_limit=2;file_mb=x;what=1;config_file={tmp_path}/c;sync=off"))
    assert (o.l0_limit, o.l1_mb, o.file_mb, o.sync) == (2, 7, 64, "OFF")


def test_commit_names(spark, path):
    t = Table.create(spark, path)
    t.insert([(b"k", b"v")])
    assert json.loads(t.store.read(f"_log/{2:020d}.json"))["version"] == 2


def test_written_states(spark, path, monkeypatch):
    from vtable.sources import log

    monkeypatch.setattr(log, "EVERY", 3)
    t = Table.create(spark, path, "id INT PRIMARY KEY, v INT")
    for k in range(6):
        t.insert([(k % 3, k)], batch=f"b{k}")
    want = rows(t.read(4))
    read = []
    monkeypatch.setattr(log.Log, "commit_at", lambda self, v, f=log.Log.commit_at: read.append(v) or f(self, v))
    u = Table(spark, path)
    assert read == [7] and u.version == 7 and rows(u.read(4)) == want and rows(u.read()) == rows(t.read())
    assert u.insert([(9, 9)], batch="b1") is None and u.log.at(5).files.keys() < u.log.head().files.keys()


def test_picker():
    from vtable.operators.compaction import pick, scores
    from vtable.sources.log import DataFile

    def f(name, level, low, high, mb=1, v=1):
        return DataFile(f"data/{name}/x", 1, mb * 1_000_000, level, 0, low, high, v, v)

    o = Options(l0_limit=2, l1_mb=10)
    files = [f("a", 0, 1, 5), f("b", 0, 4, 9), f("c", 1, 0, 3, 9), f("d", 1, 20, 30, 9), f("e", 2, 0, 99, 50)]
    assert scores(files, o) == {0: 1.0, 1: 1.8, 2: 0.5}
    assert [x.folder for x in pick(files, o)[0]] == ["c", "e"] and pick(files, o)[1] == 2
    chosen, level = pick([x for x in files if x.folder != "d"], o)
    assert {x.folder for x in chosen} == {"a", "b", "c"} and level == 1
    assert pick(files[2:3], o) == ([], 0) and pick([], o) == ([], 0)


def test_two_compactions(spark, path, monkeypatch):
    t = Table.create(spark, path, "id INT PRIMARY KEY, v INT")
    t.insert([(1, 1)])
    t.insert([(1, 2)])
    save = Table._save

    def slow(self, *a, **b):
        save(self, *a, **b)
        monkeypatch.setattr(Table, "_save", save)
        Table(spark, path).compact(everything=True)

    monkeypatch.setattr(Table, "_save", slow)
    with pytest.raises(ConflictError):
        t.compact(everything=True)
    assert rows(t.read()) == [(1, 2)] and all(r.problems == 0 for r in t.check().collect())


def folders(df):
    """Folders below data/ that a DataFrame reads."""
    return {f.split("/")[-2] for f in df.inputFiles()}


def test_only_fitting_files_are_read(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, v TEXT, n INT, INDEX(n)")
    at, made = {}, {}
    for k in range(6):
        before = set(t.log.head().files)
        at[k] = t.insert([(100 * k + i, f"v{k}", i) for i in range(5)])
        made[k] = {f.split("/")[-2] for f in set(t.log.head().files) - before if f.startswith("data/")}
    assert folders(t.changes(at[2], at[3])) == made[3]
    assert folders(t.read(at[0])) == made[0] and folders(t.read(low=300, high=301)) == made[3]
    assert folders(t.multi_get([101, 402, 999])) == made[1] | made[4] and rows(t.multi_get([101, 402, 999])) == [(101, "v1", 1), (402, "v4", 2)]
    assert folders(t.range(200, 205)) == made[2] and folders(t.where(id=500)) == made[5]
    plan = t.read()._jdf.queryExecution().toString()
    assert "max_by" not in plan, "commits that overlap no others need no resolving"
    t.upsert([(205, "new", 77)])
    assert folders(t.lookup("idx_data_n", 77)) <= made[2] | folders(t.read(low=205, high=205))
    assert rows(t.lookup("idx_data_n", 77)) == [(205, "new", 77)] and rows(t.lookup("idx_data_n", 3)) == sorted(((100 * k + 3, f"v{k}", 3) for k in range(6)), key=str)
    seen = []
    t.follow(lambda df, v: seen.append((v, folders(df))), after=at[3])
    assert [s for v, s in seen[:2]] == [made[4], made[5]]
    words = Table.create(spark, path + "w", "w TEXT PRIMARY KEY, n INT")
    for a in "abc":
        words.insert([(a + str(i), i) for i in range(3)])
    assert len(folders(words.prefix("b"))) == 1 and rows(words.prefix("b")) == [("b0", 0), ("b1", 1), ("b2", 2)]


def test_index_entries_without_a_value(spark, path):
    """Entries of a null in files that overlap in nothing else still replace each other."""
    t = Table.create(spark, path, "id INT PRIMARY KEY, n INT, INDEX(n)")
    t.insert([(1, None), (2, 5)])
    t.insert([(3, None), (4, 50)])
    t.upsert([(1, 70), (3, 500)])
    t.upsert([(3, None)])
    assert rows(t.index("idx_data_n")) == [(5, 2), (50, 4), (70, 1), (None, 3)]
    assert all(x.problems == 0 for x in t.check().collect())


def test_apart():
    f = lambda folder, low, high, level=0, single=False, nulls=0, n=10, v=1: DataFile(f"data/{folder}/{low}", n, 1, level, 0, low, high, v, v, single, nulls)
    names = lambda files: sorted((x.folder, x.low) for x in files)
    plain, mixed = apart([f("a", 1, 5), f("a", 3, 9), f("b", 10, 12), f("c", 12, 20), f("d", 30, 40, 1, True), f("e", 50, 60, 1)], None)
    assert names(plain) == [("a", 1), ("a", 3), ("d", 30)] and names(mixed) == [("b", 10), ("c", 12), ("e", 50)]
    plain, mixed = apart([f("a", 1, 5), f("b", None, None)], None)
    assert not plain and len(mixed) == 2
    plain, mixed = apart([f("a", 1, 5, nulls=1), f("b", 7, 9, nulls=1), f("c", None, None, nulls=10), f("d", 20, 30)], None)
    assert names(plain) == [("d", 20)] and len(mixed) == 3
    assert apart([f("a", 1, 5, 1, True, v=7)], 5)[0] == []


def test_diff_and_lookup_of_versions_before_compaction_and_index(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, n INT")
    old = t.insert([(1, 10), (2, 20), (3, 30)])
    t.update("id = 1", {"n": F.lit(11)})
    new = t.delete("id = 2")
    want = [(1, "update", 10, 11), (2, "delete", 20, None)]
    flat = lambda df: rows(df.select("id", "change", "old.n", "new.n"))
    assert flat(t.diff(old, new)) == want
    t.compact(everything=True)
    assert flat(t.diff(old, new)) == want and flat(t.diff(old, t.version)) == want
    name = t.add_index(["n"])
    assert rows(t.lookup(name, 10, as_of=old)) == [(1, 10)] and rows(t.lookup_range(name, 10, 25, as_of=old)) == [(1, 10), (2, 20)]
    assert rows(t.lookup(name, 11)) == [(1, 11)]
    t.vacuum()
    with pytest.raises(Expired):
        t.diff(old, new)


def test_pins_are_seen_by_others(spark, path):
    t, other = Table.create(spark, path, "id INT PRIMARY KEY, n INT"), Table(spark, path)
    t.insert([(1, 10)])
    with t.pinned() as version:
        other.upsert([(1, 11)])
        other.compact(everything=True)
        other.vacuum()
        assert rows(t.read(version)) == [(1, 10)] and other.pins() == [version]
    x = t.begin()
    x.put([(2, 2)])
    other.upsert([(1, 12)])
    other.compact(everything=True)
    other.vacuum()
    assert rows(x.read()) == [(1, 11), (2, 2)]
    x.commit()
    assert not other.pins() and not t.store.names("_txn")
    other.compact(everything=True)
    other.vacuum()
    assert rows(Table(spark, path).read()) == [(1, 12), (2, 2)]


def test_the_log_is_pruned(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, n INT")
    for k in range(4):
        t.insert([(k, k)], batch=f"s:{k}")
        t.insert([(k, -k)], batch=f"other:{k}")
    assert t.insert([(9, 9)], batch="s:2") is None and t.log.head().batches == {"s": 3, "other": 3}
    for _ in range(2):
        t.upsert([(1, 5)])
        t.compact(everything=True)
        t.vacuum()
    left = t.log.versions()
    assert left[0] > 1 and rows(Table(spark, path).read()) == [(0, 0), (1, 5), (2, -2), (3, -3)]
    with pytest.raises(SchemaError):
        Table.create(spark, path, "id INT PRIMARY KEY")
    t.backup(path + "b")
    assert rows(Table(spark, path + "b").read()) == rows(t.read()) and Table(spark, path).insert([(9, 9)], batch="s:3") is None


def test_commits_off_the_local_disk(spark, path):
    """Through Hadoop's file system: a commit is renamed when it is whole; one that has died in between is not seen; the second of two is told so."""
    t = Table.create(spark, path, "id INT PRIMARY KEY, n INT")
    for x in (t, two := Table(spark, path)):
        x.store.local = False
    t.insert([(1, 1)])
    log = two.log
    commit = Commit(t.version + 1, "write")
    with open(f"{path}/{log.name(commit.version)}.0123.tmp", "w") as f:  # what a writer that dies before the rename leaves
        f.write(commit.dump()[:20])
    assert rows(Table(spark, path).read()) == [(1, 1)] and t.version == commit.version - 1
    log.append(commit, True)
    with pytest.raises(SlotTaken):
        t.log.append(commit, True)
    two.upsert([(2, 2)])
    assert rows(t.read()) == [(1, 1), (2, 2)]

    class Elsewhere:
        def getUri(self):
            return self

        def getScheme(self):
            return "s3a"

    t.store.fs = Elsewhere()
    with pytest.raises(CorruptTable, match="whole or not at all"):
        t.store.create("_log/x", "", False)


def test_a_column_dropped_and_one_of_another_type(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, a TEXT, b REAL, INDEX(a)")
    old = t.insert([(1, "x", 1.5), (2, "y", 2.5)])
    t.upsert([(2, "z", 3.5)])
    with pytest.raises(SchemaError):
        t.drop_column("a")
    t.drop_index("idx_data_a")
    t.drop_column("a")
    t.alter_type("b", "TEXT")
    assert rows(t.read()) == [(1, "1.5"), (2, "3.5")] and rows(t.read(old)) == [(1, "1.5"), (2, "2.5")]
    with pytest.raises(SchemaError):
        t.add_column("a", "INT")
    t.add_column("c", "INT")
    t.upsert([(3, "q", 7)])
    assert rows(t.lookup(t.add_index(["c"]), 7)) == [(3, "q", 7)] and t.schema.indexes[0].id == 2
    assert all(x.problems == 0 for x in t.check().collect())


def test_a_long_transaction_has_a_short_plan(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, n INT")
    t.insert([(k, 0) for k in range(5)])
    x, sizes = t.begin(), []
    for k in range(12):
        x.savepoint(f"s{k}")
        x.update(f"id <= {k}", {"n": F.col("n") + 1})
        sizes.append(len(x.read()._jdf.queryExecution().logical().toString()))
    assert max(sizes[1:]) < 2 * sizes[1]
    x.rollback_to("s3")
    x.commit()
    assert rows(t.read()) == [(0, 3), (1, 2), (2, 1), (3, 0), (4, 0)]


def test_a_large_level_under_small_commits_is_not_shuffled(spark, path):
    t = Table.create(spark, path, "id INT PRIMARY KEY, v TEXT, INDEX(v)")
    t.insert(spark.range(1000).selectExpr("id", "'old' v"))
    t.compact(everything=True)
    old = t.version
    t.upsert([(5, "new"), (2000, "new")])
    t.delete("id = 7")
    t.upsert([(5, "newer")])
    plan = t.read()._jdf.queryExecution()
    assert "BroadcastHashJoin" in plan.executedPlan().toString() and "SortMergeJoin" not in plan.executedPlan().toString()
    got = dict(rows(t.read()))
    assert len(got) == 1000 and got[5] == "newer" and got[2000] == "new" and 7 not in got and got[8] == "old"
    assert dict(rows(t.read(old + 1)))[5] == "new" and 7 in dict(rows(t.read(old + 1))) and 7 not in dict(rows(t.read(old + 2))) and set(dict(rows(t.read(old))).values()) == {"old"}
    assert rows(t.lookup("idx_data_v", "newer")) == [(5, "newer")] and t.index("idx_data_v").count() == 1000
    f = lambda folder, v, n, level=0, single=False: DataFile(f"data/{folder}/x", n, 1, level, 0, 1, 9, v, v, single)
    assert beneath([f("a", 1, 100), f("b", 2, 10)], None)[0][0].folder == "a"
    for files in ([f("a", 3, 100), f("b", 2, 10)], [f("a", 1, 100), f("b", 2, 60)], [f("a", 1, 100, 1), f("b", 2, 10)], [f("a", 1, 10**8), f("b", 2, 10**7)]):
        assert beneath(files, None) == ([], [])


def test_observed_reads_and_scoped_messages(spark, path, caplog):
    t = Table.create(spark, path, "id INT PRIMARY KEY, v TEXT")
    with caplog.at_level("DEBUG", logger="vtable.table"):
        t.insert([(1, "a"), (2, "b"), (9, "c")])
        t.compact(everything=True)
    assert all(r.getMessage().startswith(f"{path}: ") for r in caplog.records) and {r.levelname for r in caplog.records} == {"DEBUG", "INFO"}
    df, seen = t.observed(t.read().where("id > 1"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 2, "low": 2, "high": 9}
