import json

import pytest
from pyspark.sql import functions as F

from marrow.functions import nodes as N
from marrow.operators import patch
from marrow.operators.documents import Collection
from marrow.operators.query import from_plan
from marrow.operators.wrappers import observed, retried, transacted, within
from marrow.schema import Index, Model, ValidationError, array, integer, text, to_many, to_one
from marrow.sources import io, migrate
from marrow.sources.store import Conflict, Store, UniqueViolation, WriteDenied
from marrow.streaming import live, sync

SONG = Model("song", {"title": text(unique=True), "plays": integer(default=0), "tags": array()}, indexes=(Index(("title",), unique=True),))
NOTE = Model("note", {"owner": text(), "body": text()}, soft_delete="deletedAt", timestamps=True)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", [SONG, NOTE])


def rows(store, name="song"):
    return {r.uuid: r for r in store.query(name).list()}


def test_save_patch_and_remove(store):
    store.save("song", [{"uuid": "a", "title": "A", "plays": 1, "tags": ["x", "x"]}, {"uuid": "b", "title": "B"}, {"uuid": "b", "title": "B2"}])
    assert rows(store)["b"].title == "B2" and rows(store)["b"].plays == 0
    spec = {"plays": patch.set_(N.add(N.field("plays"), 10)), "title": patch.set_(N.concat(N.field("title"), N.field("plays"))), "tags": patch.add_to_set("x", "y", "y")}
    assert store.patch_where("song", N.eq("uuid", "a"), spec) == 1
    a = rows(store)["a"]
    assert (a.plays, a.title, a["tags"]) == (11, "A1", ["x", "x", "y"])
    assert store.patch("song", "a", {"tags": patch.pull("x"), "plays": patch.mul(2)})["tags"] == ["y"]
    assert store.patch("song", "b", {"tags": patch.push("p", "p"), "plays": patch.inc()})["tags"] == ["p", "p"]
    store.remove("song", N.eq("uuid", "a"))
    assert set(rows(store)) == {"b"}


def test_unique_keys(store):
    store.save("song", [{"uuid": "a", "title": "A"}, {"uuid": "b", "title": "B"}])
    with pytest.raises(UniqueViolation):
        store.save("song", [{"uuid": "c", "title": "A"}])
    store.save("song", [{"uuid": "a", "title": "B"}, {"uuid": "b", "title": "A"}, {"uuid": "n", "title": None}, {"uuid": "m", "title": None}])
    assert {k: r.title for k, r in rows(store).items()} == {"a": "B", "b": "A", "n": None, "m": None}


def test_transactions(store):
    with store.transaction() as tx:
        tx.save("song", [{"uuid": "a", "title": "A"}])
        tx.save("note", [{"uuid": "n", "owner": "o"}])
        assert set(rows(tx)) == {"a"}
    assert store.manifest()["version"] == 1 and set(rows(store, "note")) == {"n"}
    with pytest.raises(RuntimeError), store.transaction() as tx:
        tx.save("song", [{"uuid": "z", "title": "Z"}])
        raise RuntimeError("no")
    assert set(rows(store)) == {"a"}


def test_soft_deletes(store):
    store.save("note", [{"uuid": "n", "owner": "o"}, {"uuid": "m", "owner": "p"}])
    store.remove("note", N.eq("uuid", "n"))
    assert set(rows(store, "note")) == {"m"} and store.query("note").include_deleted().count() == 2
    store.restore("note", N.eq("uuid", "n"))
    store.remove("note", N.eq("uuid", "m"), hard=True)
    assert set(rows(store, "note")) == {"n"} and store.query("note").include_deleted().count() == 1


def test_upsert(store):
    store.upsert("song", N.eq("title", "A"), {"plays": patch.set_(5)}, {"tags": ["new"]})
    store.upsert("song", N.eq("title", "A"), {"plays": patch.inc(1)}, {"tags": ["never"]})
    (r,) = rows(store).values()
    assert (r.title, r.plays, r["tags"]) == ("A", 6, ["new"])


def test_policies_and_hooks(spark, tmp_path):
    seen = []
    s = Store(spark, f"file://{tmp_path}/p", [NOTE], policy=lambda m: N.eq("owner", "alice"), can_write=lambda m, rows: rows.filter("after.owner <> 'alice'").limit(1).count() == 0, hooks={"before_commit": lambda m, df: df.withColumn("body", F.upper("body")), "after_commit": seen.append}, observe=seen.append)
    s.save("note", [{"uuid": "n", "owner": "alice", "body": "x"}])
    assert rows(s, "note")["n"].body == "X" and seen[0] == ["note"] and seen[1]["changes"] == 1
    with pytest.raises(WriteDenied):
        s.save("note", [{"uuid": "m", "owner": "bob"}])
    assert s.query("note").count() == 1


def test_changes_and_subscriptions(store):
    calls = []
    stop = store.subscribe(lambda name, df: calls.append(sorted(r.key for r in df.collect())), "song", N.gt("plays", 5))
    store.save("song", [{"uuid": "a", "title": "A", "plays": 9}, {"uuid": "b", "title": "B", "plays": 1}])
    store.patch_where("song", N.eq("uuid", "b"), {"plays": patch.inc(1)})
    store.patch_where("song", N.everything(), {"plays": patch.set_(0)})
    stop()
    store.remove("song", N.eq("uuid", "a"))
    assert calls == [["a"], ["a"]]
    log = store.changes().collect()
    assert [r.seq for r in log] == list(range(1, 7)) and log[-1].kind == "removed" and json.loads(log[0].after)["plays"] == 9


def test_live_queries(store):
    store.save("song", [{"uuid": "a", "title": "A", "plays": 9}])
    query = live.LiveQuery(store, store.query("song").filter(N.gt("plays", 5)), lambda q: sorted(r.uuid for r in q.list()))
    got = []
    stop = query.subscribe(got.append)
    store.save("song", [{"uuid": "b", "title": "B", "plays": 7}])
    query.drain()
    store.save("song", [{"uuid": "c", "title": "C", "plays": 1}])
    query.drain()
    stop()
    assert got == [["a"], ["a", "b"]] and query.value == ["a", "b"]


def test_migrations(spark, tmp_path):
    from pyspark.sql import types as T

    s = Store(spark, f"file://{tmp_path}/m", [SONG])
    s.save("song", [{"uuid": "a", "title": "12"}])
    steps = [
        migrate.Migration("1", lambda x: x.add_column("song", "stars", T.LongType(), 3), lambda x: x.drop_column("song", "stars")),
        migrate.Migration("2", lambda x: x.alter_column_type("song", "title", T.LongType()), lambda x: x.alter_column_type("song", "title", T.StringType())),
    ]
    assert migrate.migrate(s, steps) == ["1", "2"] and migrate.migrate(s, steps) == []
    assert s.table("song").first().stars == 3 and s.table("song").first().title == 12
    assert migrate.rollback(s, steps, 2) == ["2", "1"] and "stars" not in s.table("song").columns
    with pytest.raises(ValueError):
        migrate.migrate(s, [steps[0], steps[0]])


def test_copies_and_fan_out(store, spark, tmp_path):
    store.save("song", [{"uuid": "a", "title": "A", "plays": 1}, {"uuid": "b", "title": "B", "plays": 5}])
    other = Store(spark, f"file://{tmp_path}/other", [SONG])
    assert io.copy(store, other, ["song"], N.gt("plays", 2), lambda df: df.withColumn("title", F.lower("title"))) == {"song": 1}
    assert rows(other)["b"].title == "b"

    def broken(_):
        raise OSError("full")

    assert [type(e) for e in io.write_all(store.table("song"), [lambda df: other.save("song", df), broken], strict=False)] == [type(None), OSError]
    assert other.sql("SELECT count(*) AS n FROM song WHERE plays > :p", p=0).first().n == 2


def test_json_exports(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"_id": {"$oid": "5f"}, "title": "A", "plays": 3}\n{"_id": "6a", "tags": ["q"]}\n')
    got = {r.uuid: r for r in io.json_lines(spark, str(tmp_path / "x.json"), SONG, "_id").collect()}
    assert got["5f"].plays == 3 and got["6a"]["tags"] == ["q"] and got["6a"].title is None


def test_collections(store):
    c = Collection(store, "song")
    c.insert_many([{"uuid": "a", "title": "A", "plays": 1, "tags": ["x"]}, {"uuid": "b", "title": "B", "plays": 2}])
    assert c.update_many({"plays": {"$gte": 1}}, {"$inc": {"plays": 10}, "$push": {"tags": {"$each": ["y", "z"]}}}) == 2
    assert c.find_one_and_update({"title": "A"}, {"$set": {"title": "AA"}}).title == "AA"
    assert c.find_one_and_update({"title": "AA"}, {"$pull": {"tags": "x"}}, after=False)["tags"] == ["x", "y", "z"]
    assert c.update_one({"title": "new"}, {"$set": {"plays": 3}, "$setOnInsert": {"tags": ["i"]}}, upsert=True) == 0
    assert c.find_one({"title": "new"})["tags"] == ["i"] and c.replace_one({"title": "new"}, {"title": "newer"}) == 1
    assert c.delete_one({"title": "newer"}) == 1 and c.delete_many({"plays": {"$gt": 11}}) == 1 and c.count_documents() == 1
    assert c.aggregate([{"$match": {}}, {"$count": "n"}]).first().n == 1


def test_wrappers():
    reports, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return [1, 2]

    assert observed("q", lambda: retried(flaky, sleep=lambda s: None), reports.append) == [1, 2]
    assert reports[0]["rows"] == 2 and reports[0]["ok"] and len(tries) == 3


def test_clock():
    now = [1000]
    c = sync.Clock("n", lambda: now[0])
    a, b = c.now(), c.now()
    now[0] = 500
    assert a < b < c.now()
    c.update("000000000005000:000003:m")
    c.update("nonsense")
    assert c.now() > "000000000005000:000003:m"


@pytest.mark.parametrize("by_field", [False, True])
def test_replicas(by_field):
    at = [1000]

    def tick():
        at[0] += 1
        return at[0]

    server = sync.Target(by_field)
    a, b = (sync.Replica(sync.Clock(n, tick), server) for n in "ab")
    a.save("note", "n", {"title": "t", "body": "b"})
    for r in (a, b):
        r.sync()
    a.save("note", "n", {"title": "A", "body": "b"})
    b.save("note", "n", {"title": "t", "body": "B"})
    for r in (a, b, a, b):
        r.sync()
    want = {"title": "A", "body": "B"} if by_field else {"title": "t", "body": "B"}
    assert a.get("note", "n") == b.get("note", "n") == want
    a.remove("note", "n")
    for r in (a, b):
        r.sync()
    assert b.get("note", "n") is None
    b.save("note", "n", {"title": "back", "body": ""})
    for r in (b, a):
        r.sync()
    assert a.get("note", "n")["title"] == "back"


def test_streamed_fold_equals_the_batch(spark, tmp_path):
    changes = [(i + 1, "m", f"k{i % 3}", "removed" if i % 5 == 4 else "saved", json.dumps({"i": i}), f"{(i * 7) % 11:015d}:000000:n", None) for i in range(20)]
    df = spark.createDataFrame(changes, sync.CHANGE)
    for k in range(2):
        df.filter(F.col("seq") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    want = {r.key: (r.version, r.seq) for r in sync.lww(df).collect()}
    stream = sync.lww_stream(spark.readStream.schema(sync.CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("folded").start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("folded").orderBy("version").collect():
        got[r.key] = (r.version, r.seq)
    assert got == want


def test_inverse_relations_stay_in_step(spark, tmp_path):
    user = Model("user", {"events": to_many("event", inverse="users"), "team": to_one("team", inverse="lead")})
    event, team = Model("event", {"users": to_many("user")}), Model("team", {"lead": to_one("user")})
    s = Store(spark, f"file://{tmp_path}/i", [user, event, team])
    s.save("event", [{"uuid": "e1", "users": ["x"]}, {"uuid": "e2"}])
    s.save("team", [{"uuid": "t"}])
    s.save("user", [{"uuid": "u1", "events": ["e1", "e2"], "team": "t"}, {"uuid": "u2", "events": ["e2"]}])
    assert {k: r["users"] for k, r in rows(s, "event").items()} == {"e1": ["x", "u1"], "e2": ["u1", "u2"]} and rows(s, "team")["t"].lead == "u1"
    s.save("user", [{"uuid": "u1", "events": ["e1"]}])
    assert {k: r["users"] for k, r in rows(s, "event").items()} == {"e1": ["x", "u1"], "e2": ["u2"]} and rows(s, "team")["t"].lead is None


def test_results_are_kept_until_a_commit(store):
    store.save("song", [{"uuid": "a", "title": "A", "plays": 9}])
    q = lambda: store.query("song").filter(N.gt("plays", 5))
    first = store.cached(q())
    assert store.cached(q()) is first and first.count() == 1
    store.save("song", [{"uuid": "b", "title": "B", "plays": 7}])
    assert store.cached(q()) is not first and store.cached(q()).count() == 2


def test_live_queries_follow_related_models(spark, tmp_path):
    band, album = Model("band", {"name": text()}), Model("album", {"band": to_one("band")})
    s = Store(spark, f"file://{tmp_path}/r", [band, album])
    s.save("band", [{"uuid": "b", "name": "old"}])
    s.save("album", [{"uuid": "a", "band": "b"}])
    query, got = live.LiveQuery(s, s.query("album").filter(N.eq("band.name", "new")), lambda q: [r.uuid for r in q.list()]), []
    stop = query.subscribe(got.append)
    s.save("band", [{"uuid": "b", "name": "new"}])
    query.drain()
    stop()
    assert got == [[], ["a"]]


def test_a_writer_that_dies_before_the_manifest_leaves_no_trace(store, monkeypatch):
    store.save("song", [{"uuid": "a", "title": "A"}])
    real = store.files.move
    monkeypatch.setattr(store.files, "move", lambda s, t: (_ for _ in ()).throw(KeyboardInterrupt()) if "_manifests" in t else real(s, t))
    with pytest.raises(KeyboardInterrupt):
        store.save("song", [{"uuid": "b", "title": "B"}])
    monkeypatch.undo()
    assert set(rows(store)) == {"a"} and [r.seq for r in store.changes().collect()] == [1]
    store.save("song", [{"uuid": "c", "title": "C"}])
    assert [(r.seq, r.key) for r in store.changes().collect()] == [(1, "a"), (2, "c")]


def test_changes_of_a_writer_that_dies_after_the_manifest_are_published(store, monkeypatch):
    monkeypatch.setattr(store, "publish", lambda: None)
    store.save("song", [{"uuid": "a", "title": "A"}])
    monkeypatch.undo()
    other = Store(store.spark, store.path, [SONG, NOTE])
    assert [r.key for r in other.changes().collect()] == ["a"]
    other.save("song", [{"uuid": "b", "title": "B"}])
    assert [(r.seq, r.key) for r in other.changes().collect()] == [(1, "a"), (2, "b")]


def test_the_second_of_two_writers_gets_a_conflict(spark, store):
    other = Store(spark, store.path, [SONG, NOTE])
    store.hooks["before_commit"] = lambda m, df: (store.hooks.clear(), other.save("song", [{"uuid": "o", "title": "O"}]), df)[2]
    with pytest.raises(Conflict):
        store.save("song", [{"uuid": "a", "title": "A"}])
    assert set(rows(store)) == {"o"}
    transacted(store, lambda tx: tx.save("song", [{"uuid": "a", "title": "A"}]))
    assert set(rows(store)) == {"a", "o"} and [r.key for r in store.changes().collect()] == ["o", "a"]


def test_nothing_hidden_is_seen_or_changed(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/h", [NOTE, SONG])
    s.save("note", [{"uuid": "n", "owner": "alice", "body": "x"}, {"uuid": "m", "owner": "bob", "body": "y"}])
    s.policy = lambda m: N.eq("owner", "alice") if m.name == "note" else None
    c = Collection(s, "note")
    assert c.count_documents() == 1 and [r.uuid for r in c.find().list()] == ["n"] and c.find_one({"owner": "bob"}) is None
    assert c.aggregate([{"$count": "n"}]).first().n == 1 and s.sql("SELECT count(*) AS n FROM note").first().n == 1
    assert from_plan(s.catalog, {"model": "note", "where": N.All().to_json()}, policy=s.policy).count() == 1
    assert c.update_many({}, {"$set": {"body": "z"}}) == 1 and c.find_one_and_update({"owner": "bob"}, {"$set": {"body": "q"}}) is None
    assert c.replace_one({"owner": "bob"}, {"body": "q"}) == 0 and c.delete_one({"owner": "bob"}) == 0 and c.delete_many({"owner": "bob"}) == 0
    s.upsert("note", N.eq("owner", "bob"), {"body": patch.set_("new")})  # bob's note isn't seen, so another is made
    with pytest.raises(WriteDenied):
        s.save("note", [{"uuid": "m", "owner": "alice"}])
    with pytest.raises(WriteDenied):
        s.upsert("note", N.eq("uuid", "m"), {"body": patch.set_("mine")})
    s.remove("note", N.eq("uuid", "m"), hard=True)
    got = {r.uuid: r.body for r in s.table("note").collect()}
    assert got["n"] == "z" and got["m"] == "y" and sorted(got.values()) == ["new", "y", "z"]


def test_live_queries_start_on_an_empty_log_and_lose_nothing(store):
    got = []
    query = live.LiveQuery(store, store.query("song"), lambda q: (q.count(), len(got) == 0 and store.save("song", [{"uuid": "a", "title": "A"}]))[0])
    stop = query.subscribe(got.append)  # a commit falls between the first run and the start of the stream
    query.drain()
    stop()
    assert got[0] == 0 and got[-1] == 1


def test_keys_that_are_no_text_are_kept(spark, tmp_path):
    m = Model("n", {"k": integer(), "x": text()}, key="k")
    s = Store(spark, f"file://{tmp_path}/k", [m])
    s.save("n", [{"k": 3, "x": "a"}, {"k": 3, "x": "b"}])
    assert [(r.k, r.x) for r in s.query("n").list()] == [(3, "b")] and s.changes().first().key == "3"
    with pytest.raises(ValidationError):
        s.save("n", [{"x": "no key"}])


def test_copies_in_batches_and_fan_out_of_updates(store, spark, tmp_path):
    store.save("song", [{"uuid": f"u{i}", "title": f"T{i}", "plays": i} for i in range(7)])
    other, seen = Store(spark, f"file://{tmp_path}/b", [SONG]), []
    assert io.copy(store, other, ["song"], batch=3, on_batch=lambda name, n: seen.append(n)) == {"song": 7}
    assert seen == [3, 6, 7] and other.query("song").count() == 7
    both = io.FanOut([store, other])
    both.upsert("song", N.eq("title", "new"), {"plays": patch.set_(1)})
    assert both.patch_where("song", N.gt("plays", 3), {"plays": patch.inc(10)}) == 3
    both.remove("song", N.eq("plays", 0))
    assert rows(store) == rows(other) and len(rows(store)) == 7
    broken = io.FanOut([store, Store(spark, f"file://{tmp_path}/c", [NOTE])], strict=False)
    broken.remove("song", N.everything())
    assert not rows(store) and type(broken.errors[1]) is KeyError


def test_durable_targets_go_on_after_a_restart(spark, tmp_path):
    place = f"file://{tmp_path}/sync"
    change = lambda key, v: {"model": "m", "key": key, "kind": "saved", "record": {"v": v}, "version": v, "fields": None}
    first = sync.StoreTarget(Store(spark, place, []))
    assert first.push([change("a", "1"), change("b", "1"), change("a", "2")]) == []
    second = sync.StoreTarget(Store(spark, place, []))
    assert second.seq == 3 and [c["version"] for c in second.push([change("a", "1")])] == ["2"]
    second.push([change("a", "3")])
    log, cursor = second.pull(3)
    assert [(c["seq"], c["record"]) for c in log] == [(4, {"v": "3"})] and cursor == 4
    first.push([change("c", "1")])  # its number is behind: another writer has committed, so it starts again from the log
    assert sorted(c["seq"] for c in first.pull()[0]) == [1, 2, 3, 4, 5]


def test_field_merges_with_removals(spark):
    stamp = lambda n: f"{n:015d}:000000:n"
    row = lambda seq, key, kind, v, **r: (seq, "m", key, kind, json.dumps(r) if r else None, stamp(v), None)
    changes = [row(1, "gone", "saved", 1, a="1"), row(2, "gone", "removed", 2), row(3, "back", "saved", 1, a="1", b="1"), row(4, "back", "removed", 2), row(5, "back", "saved", 3, a="2"), row(6, "never", "removed", 9)]
    got = {r.key: r.record for r in sync.merge_fields(spark.createDataFrame(changes, sync.CHANGE)).collect()}
    assert got == {"back": {"a": "2", "b": "1"}}


def test_time_limits_and_guards(tmp_path):
    import time

    cancelled = []
    with pytest.raises(TimeoutError):
        within(0.05, lambda: time.sleep(1), lambda: cancelled.append(1))
    assert cancelled == [1] and within(5, lambda: 3) == 3
    with pytest.raises(KeyError):
        within(5, lambda: {}["x"])
    with pytest.raises(ValueError):
        Model("ok", {"bad name": text()})


def test_relational_tables(spark):
    url = "jdbc:derby:memory:marrow;create=true"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "k int, name string")
    io.write_jdbc(df, url, "people", batch=7)
    io.write_jdbc(df.limit(1), url, "people")
    got = io.jdbc(spark, url, "people", partitionColumn="k", lowerBound="0", upperBound="20", numPartitions="3")
    assert got.count() == 21 and got.filter("k = 3").first()["name"] == "n3"
