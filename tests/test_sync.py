"""Pull, edit and push against a server that forgets to answer; crashes; the streaming source."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions.payload import canonical, canonical_json, canonical_map
from quarry.streaming import feed, store as S


class Server:
    """Records by id; write() may commit and then not answer."""

    def __init__(self, spark, silent=0):
        self.spark, self.silent, self.rows, self.keys, self.log, self.clock = spark, silent, {}, {}, [], 0

    def now(self):
        return f"2026-08-01 00:{self.clock // 60:02d}:{self.clock % 60:02d}"

    def put(self, key, payload, tick=0):
        self.clock += tick
        self.rows[key] = (self.rows.get(key, (0,))[0] + 1, payload, self.now())

    def changes(self, since, limit):
        rows = [(k, canonical(p), v, at) for k, (v, p, at) in self.rows.items()]
        return feed.list_changes(self.spark.createDataFrame(rows, feed.SCHEMA), since, limit)

    def get(self, key):
        return self.rows.get(key)

    def write(self, key, payload, base, idempotency_key):
        if idempotency_key in self.keys:
            return self.keys[idempotency_key]
        if self.rows.get(key, (0,))[0] != base:
            raise S.WriteConflict(key)
        self.put(key, payload, 1)
        self.log.append(key)
        self.keys[idempotency_key] = self.rows[key]
        if self.silent:
            self.silent -= 1
            raise S.WriteTimeout(key)
        return self.rows[key]


@pytest.fixture
def server(spark):
    s = Server(spark)
    for i in range(5):
        s.put(f"E{i}", {"price": i, "name": "x"})
    return s


def opened(spark, tmp_path, tenant="t"):
    return S.Store(spark, f"file://{tmp_path}/store", tenant)


def crash(at):
    def hook(where):
        if where == at:
            raise KeyboardInterrupt(where)

    return hook


def test_pull_takes_all_of_a_second_and_keeps_the_cursor_when_it_cannot(spark, tmp_path, server):
    st = opened(spark, tmp_path)
    with pytest.raises(S.PullCapacityError):
        S.pull(server.changes, st, 2, 4)
    assert st.cursor() is None
    for at in ("after_record", "before_commit"):
        with pytest.raises(KeyboardInterrupt):
            S.pull(server.changes, st, 2, crash_hook=crash(at))
        assert opened(spark, tmp_path).state()["records"].isEmpty()
    assert S.pull(server.changes, st, 2) == 5 and st.cursor() == "2026-08-01 00:00:00"
    assert st.record("E0")["updated_utc"] == "2026-07-31T16:00:00+00:00"
    assert S.pull(server.changes, st, 2, full=True) == 0 and st.state()["applied"].count() == 5
    with pytest.raises(ValueError):
        opened(spark, tmp_path, "other")


def test_local_edits_survive_and_conflicts_are_set_aside(spark, tmp_path, server):
    st = opened(spark, tmp_path)
    S.pull(server.changes, st)
    st.edit("E1", {"price": 9})
    server.put("E1", {"price": 8}, 5)
    S.pull(server.changes, st)
    assert json.loads(st.record("E1")["payload"]) == {"price": 9}
    assert st.state()["conflicts"].first()["reason"] == "remote_changed_while_dirty"
    assert S.push(server, st) == 0 and server.get("E1")[1] == {"price": 8}
    with pytest.raises(ValueError):
        st.edit("E1", {"price": 1})


def test_push_writes_once(spark, tmp_path, server):
    st = opened(spark, tmp_path)
    S.pull(server.changes, st)
    st.edit("E2", {"price": 7})
    with pytest.raises(KeyboardInterrupt):
        S.push(server, st, crash_hook=crash("after_outbox_commit"))
    st = opened(spark, tmp_path)
    key = st.state()["outbox"].first()["key"]
    server.silent = 1
    assert S.push(server, st, max_attempts=1) == 0
    assert st.state()["outbox"].first()["state"] == "uncertain"
    with pytest.raises(ValueError):
        st.edit("E2", {"price": 6})
    S.pull(server.changes, st)  # sees our own write early: no conflict
    assert st.state()["conflicts"].isEmpty()
    server.keys.clear()  # the server has forgotten the key
    assert S.push(server, st) == 1 and server.log == ["E2"]
    out = st.state()["outbox"].first()
    assert out["state"] == "done" and out["key"] == key
    assert st.record("E2")["version"] == 2 and not st.record("E2")["dirty"]
    st.edit("NEW", {"price": 1})
    assert S.push(server, st) == 1 and server.get("NEW")[0] == 1
    server.put("E3", {"price": 100}, 3)
    st.edit("E3", {"price": 5})
    assert S.push(server, st) == 0
    assert st.state()["conflicts"].first()["reason"] == "compare_and_swap_conflict" and server.get("E3")[1] == {"price": 100}


class FolderServer:
    """Records and keys as files, so that every process meets the same; file names are made once or not at all."""

    def __init__(self, folder):
        self.folder = folder

    def get(self, key):
        try:
            with open(f"{self.folder}/{key}.json") as f:
                return tuple(json.load(f))
        except FileNotFoundError:
            return None

    def write(self, key, payload, base, idempotency_key):
        import os

        kept = f"{self.folder}/key-{idempotency_key}"
        if os.path.exists(kept):
            return self.get(key)
        if (self.get(key) or (0,))[0] != base:
            raise S.WriteConflict(key)
        with open(f"{self.folder}/{key}.json", "w") as f:
            json.dump([base + 1, payload, "2026-08-01 00:00:00"], f)
        with open(f"{self.folder}/log", "a") as f:
            f.write(f"{key}\n")
        open(kept, "x").close()
        if payload.get("silent"):
            raise S.WriteTimeout(key)
        return self.get(key)


def test_push_of_many_from_executors(spark, tmp_path):
    from functools import partial

    folder = tmp_path / "server"
    folder.mkdir()
    st = opened(spark, tmp_path)
    edits = [(f"N{i}", canonical({"price": i} | ({"silent": 1} if i == 3 else {}))) for i in range(40)]
    st.commit(S.sync.edit(st.state(), spark.createDataFrame(edits, "id string, payload string")), st.meta())
    (folder / "N7.json").write_text(json.dumps([4, {"price": 1}, "2026-08-01 00:00:00"]))
    make = partial(FolderServer, str(folder))
    assert S.push_all(make, st, max_attempts=1, tasks=4) == 38
    states = {r["id"]: r["state"] for r in st.state()["outbox"].collect()}
    assert states["N3"] == "uncertain" and states["N7"] == "conflict" and sorted(states.values()).count("done") == 38
    assert S.push_all(make, st, tasks=4) == 1  # the silent one is known by its key
    assert sorted((folder / "log").read_text().split()) == sorted({f"N{i}" for i in range(40)} - {"N7"})
    assert not st.record("N3")["dirty"] and st.record("N5")["version"] == 1
    with pytest.raises(ValueError):
        S.push_all(make, st, max_attempts=0)


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from quarry.plans import scratch

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

            class getConf:
                get = staticmethod(lambda name: None)

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster)
    Cluster.sparkContext.master = "local[4]"
    monkeypatch.setattr(scratch, "_own_dir", ["file:///own"])
    assert scratch.shared_dir(Cluster) == "file:///own"


def test_stream(spark, tmp_path):
    src = tmp_path / "feed"
    src.mkdir()
    row = lambda k, v, at: json.dumps({"external_id": k, "payload": '{"v":%d}' % v, "version": v, "updated_at": at}) + "\n"
    (src / "a.json").write_text(row("A", 1, "2026-08-01 00:00:00") + row("B", 1, "2026-08-01 00:00:00"))
    st = opened(spark, tmp_path)
    S.apply_stream(feed.read_changes(spark, str(src)), st, f"{tmp_path}/cp").awaitTermination(120)
    (src / "b.json").write_text(row("A", 2, "2026-08-01 00:00:00") + row("C", 1, "2026-08-01 00:00:05"))
    S.apply_stream(feed.read_changes(spark, str(src)), st, f"{tmp_path}/cp").awaitTermination(120)
    assert {r["id"]: r["version"] for r in st.state()["records"].collect()} == {"A": 2, "B": 1, "C": 1}
    assert st.state()["applied"].count() == 4 and st.cursor() == "2026-08-01 00:00:05"


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [1, {"d": 2, "c": null}]}',), (None,)], "j string")
    assert [r[0] for r in df.select(canonical_json(F.col("j"))).collect()] == ['{"a":[1,{"c":null,"d":2}],"b":1}', None]
    m = spark.createDataFrame([({"b": "1", "a": "2"},)], "m map<string,string>")
    assert m.select(canonical_map(F.col("m"))).first()[0] == '{"a":"2","b":"1"}'
