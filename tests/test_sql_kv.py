"""The SQL session, the key-value store and the shells."""

import pytest

from vtable.cli import KvShell, SqlShell, main, statements
from vtable.kv import KV
from vtable.plans.sql import Session, SqlError
from vtable.table import UniqueViolation


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_kv(spark, tmp_path):
    kv = KV(spark, f"{tmp_path}/kv")
    kv.put_many([("user:1", "Alice"), ("user:2", "Bob"), ("z", "1"), ("z", "2")])
    v = kv.table.version
    kv.delete("user:1")
    kv.put("user:2", "")
    kv = KV(spark, f"{tmp_path}/kv")
    assert kv.get("user:1") is None and kv.get("user:2") is None and kv.get("user:1", v) == b"Alice" and kv.get("z") == b"2"
    assert kv.count() == 1
    kv.put_many([(f"key_{i:03d}", f"v{i}") for i in range(20)])
    assert [k for k, _ in kv.scan("key_005", 3)] == [b"key_005", b"key_006", b"key_007"]
    assert len(kv.prefix("key_01")) == 10 and kv.prefix("nope") == []
    c = kv.iterator()
    kv.put("zz", "later")
    c.seek("key_018")
    got = []
    while c.valid():
        got.append((c.key(), c.value()))
        c.next()
    assert got == [(b"key_018", b"v18"), (b"key_019", b"v19"), (b"z", b"2")]


def test_sql(spark, tmp_path):
    s = Session(spark)
    s.sql(f"CREATE VIRTUAL TABLE users USING vtable('{tmp_path}/u', 'off', 'id INT PRIMARY KEY, name TEXT, age REAL, UNIQUE INDEX(name)', 'l0_limit=2;x=1')")
    assert s.table("users").options.sync == "OFF" and s.table("users").options.l0_limit == 2
    s.sql("INSERT INTO users VALUES (1, 'Alice', 30.5), (2, 'Bob, the 2nd', 40.0), (2, 'Bob', 41.0)")
    s.sql("INSERT OR IGNORE INTO users (id, name) SELECT id, 'x' FROM users WHERE id = 1")
    assert rows(s.sql("SELECT id, name, age FROM users")) == [(1, "Alice", 30.5), (2, "Bob", 41.0)]
    s.sql("UPDATE users SET name = concat(name, ', ', 'jr'), age = age + 1 WHERE id = 2")
    s.sql("BEGIN")
    s.sql("INSERT INTO users VALUES (3, 'Carl', 1.0)")
    s.sql("SAVEPOINT a")
    s.sql("DELETE FROM users WHERE id = 1")
    assert rows(s.sql("SELECT id FROM users")) == [(2,), (3,)]
    s.sql("ROLLBACK TO a")
    s.sql("RELEASE a")
    s.sql("COMMIT")
    assert rows(s.sql("SELECT id, name FROM users WHERE age > :x", {"x": 0})) == [(1, "Alice"), (2, "Bob, jr"), (3, "Carl")]
    with pytest.raises(UniqueViolation):
        s.sql("INSERT OR ABORT INTO users VALUES (3, 'Z', 1.0)")
    s.sql("BEGIN")
    s.sql("DELETE FROM users")
    s.sql("ROLLBACK")
    s.sql("ALTER TABLE users ADD COLUMN note TEXT")
    s.sql("CREATE INDEX ON users (age)")
    s.sql("ALTER TABLE users RENAME TO people")
    assert s.sql("SELECT count(*) n FROM people WHERE note IS NULL").first().n == 3
    s.sql("COMPACT people")
    assert all(r.problems == 0 for r in s.sql("TABLE people CHECK").collect())
    s.sql(f"BACKUP people TO '{tmp_path}/b'")
    s.sql("DROP TABLE people")
    s.mount("again", f"{tmp_path}/b")
    assert s.sql("SELECT count(*) n FROM again a JOIN again b ON a.id = b.id").first().n == 3
    for bad in ("COMMIT", "SAVEPOINT x", "DELETE FROM nowhere"):
        with pytest.raises(SqlError):
            s.sql(bad)


def test_shells(spark, tmp_path):
    k = KvShell(spark)
    assert k.run("get a") == ["no database is open"] and k.run(f"open {tmp_path}/k") == ["OK"]
    assert [k.run(x) for x in ("put a 1 2", "get a", "scan a", "count", "del a", "get a")] == [["OK"], ["1 2"], ["a = 1 2"], ["1"], ["OK"], ["(nil)"]]
    assert k.run("what")[0].startswith("can't read") and k.run("exit") is None and k.run("stats")[0].startswith("kind|level")
    q = SqlShell(spark, f"{tmp_path}/s")
    assert q.run("INSERT INTO data VALUES (X'61', X'62');") == ["OK"]
    assert q.run("SELECT hex(key) k FROM data;") == ["k", "61"] and "commits=1" in q.run(".stats") and q.run(".quit") is None
    assert list(statements(["SELECT 1,\n", "2;\n", ".stats\n", "x"])) == ["SELECT 1,\n2;\n", ".stats", "x\n"]


def test_sql_shell_prints_every_row(spark, tmp_path, capsys):
    q = SqlShell(spark, f"{tmp_path}/s")
    assert q.run("SELECT id FROM range(2500) ORDER BY id;") == ["id", *map(str, range(2500))]
    main(["sql", f"{tmp_path}/t", "--sql", "SELECT id FROM range(1200) ORDER BY id"])
    assert capsys.readouterr().out.split() == ["id", *map(str, range(1200))]
