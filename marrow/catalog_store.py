"""Registered queries that write to a store in the shared folder and read back, each with the SQL of the result.

Their stores are new at every call.  Guards are rows as well: what is refused, with whether it was."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.catalog import _int, _q, _table, registered
from marrow.functions import nodes as N
from marrow.operators import documents, patch
from marrow.operators import query as Q
from marrow.operators.documents import Collection, Unsupported
from marrow.operators.query import Catalog, from_plan
from marrow.operators.wrappers import observed, retried, transacted, within
from marrow.schema import Factory, Index, Model, ValidationError, array, boolean, date, embedded, fingerprint, float_, integer, scalar, sequence, text, to_many, to_one
from marrow.session import shared_dir
from marrow.sources import io, migrate
from marrow.sources.store import Conflict, Store, Tables, UniqueViolation, WriteDenied, matching
from marrow.streaming import live, sync

CUSTOMER = Model("customer", {"c_custkey": integer(), "c_name": text(unique=True), "c_nationkey": integer(), "c_acctbal": float_(), "c_mktsegment": text(), "tags": array()}, key="c_custkey", soft_delete="deletedAt")
SUPPLIER = Model("supplier", {"s_suppkey": integer(), "s_name": text(), "s_nationkey": integer(), "s_acctbal": float_()}, key="s_suppkey")


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/marrow-store-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal", "c_mktsegment", F.array("c_mktsegment").alias("tags"), F.lit(None).cast("timestamp").alias("deletedAt"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("long"))


def _store(spark: SparkSession, d: str, **options: Any) -> Store:
    """A store with all customers."""
    store = Store(spark, _place(spark), [CUSTOMER, SUPPLIER])
    store.save("customer", _customers(spark, d))
    for name, value in options.items():
        setattr(store, name, value)
    return store


def _mod(n: int, k: int = 0) -> N.Predicate:
    return N.compare(N.mod(N.field("c_custkey"), n), "=", k)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# saves, updates, removals
@registered("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 'new', 5.0")
def store_save_upserts_by_key(spark, d):
    store = _store(spark, d)
    new = _rows(spark, [(-1, "new", 1, 5.0, "x", ["x"], None)], "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string, tags array<string>, deletedAt timestamp")
    store.save("customer", _customers(spark, d).filter(F.col("c_custkey") % 3 == 0).withColumn("c_acctbal", F.col("c_acctbal") + 1).union(new))
    return store.query("customer").frame().select("c_custkey", "c_name", "c_acctbal")


@registered("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY 1")
def store_raw_sql(spark, d):
    return _store(spark, d).sql("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > :least GROUP BY c_mktsegment", least=100)


@registered("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 + 1 ELSE c_acctbal END AS c_acctbal,
CASE WHEN c_custkey % 2 = 0 THEN c_name || '/' || c_mktsegment ELSE c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
CASE WHEN c_custkey % 4 = 0 THEN 'a' WHEN c_custkey % 2 = 0 THEN c_mktsegment || ',a' ELSE c_mktsegment END AS tags FROM customer""")
def store_patch_where(spark, d):
    store = _store(spark, d)
    with store.transaction() as tx:
        even = _mod(2)
        tx.patch_where("customer", even, {"c_acctbal": patch.mul(2), "c_name": patch.set_(N.concat(N.field("c_name"), "/", N.field("c_mktsegment"))), "c_nationkey": patch.unset(), "tags": patch.push("a", "b")})
        tx.patch_where("customer", even, {"c_acctbal": patch.inc(1), "tags": patch.add_to_set("a", "a")})
        tx.patch_where("customer", even, {"tags": patch.pull("b")})
        tx.patch_where("customer", _mod(4), {"tags": patch.set_(["a"])})
    return store.query("customer").frame().select("c_custkey", "c_acctbal", "c_name", "c_nationkey", F.array_join("tags", ",").alias("tags"))


@registered("SELECT c_custkey, c_acctbal + 10 AS c_acctbal, (SELECT count(*) FROM customer) AS customers FROM customer WHERE c_custkey = 7")
def store_patch_one(spark, d):
    store = _store(spark, d)
    row = store.patch("customer", 7, {"c_acctbal": patch.inc(10)})
    return _rows(spark, [(row["c_custkey"], row["c_acctbal"], store.query("customer").count())], "c_custkey long, c_acctbal double, customers long")


@registered("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'seven' ELSE c_name END AS c_name, c_mktsegment FROM customer UNION ALL SELECT -5, 'minus', 'fresh'")
def store_upsert_by_match(spark, d):
    store = _store(spark, d)
    store.upsert("customer", N.eq("c_custkey", 7), {"c_name": patch.set_("seven")}, {"c_mktsegment": "never"})
    store.upsert("customer", N.eq("c_custkey", -5), {"c_name": patch.set_("minus")}, {"c_mktsegment": "fresh"})
    return store.query("customer").frame().select("c_custkey", "c_name", "c_mktsegment")


@registered("SELECT c_custkey, c_custkey % 6 = 0 AS gone FROM customer WHERE c_custkey % 7 <> 0")
def store_soft_delete_and_restore(spark, d):
    store = _store(spark, d)
    store.remove("customer", _mod(3))
    store.restore("customer", _mod(6, 3))
    store.remove("customer", _mod(7), hard=True)
    live_rows = store.query("customer").frame().select("c_custkey")
    return store.query("customer").include_deleted().frame().select("c_custkey").join(live_rows.withColumn("live", F.lit(True)), "c_custkey", "left").select("c_custkey", F.col("live").isNull().alias("gone"))


@registered("SELECT (SELECT count(*) FROM customer) + 1 AS customers, (SELECT count(*) FROM supplier) AS suppliers, 2::BIGINT AS commits, true AS rolled_back, true AS own_writes")
def store_transactions(spark, d):
    store = _store(spark, d)
    with store.transaction() as tx:  # interactive: it reads what it wrote
        tx.save("supplier", _suppliers(spark, d))
        own = tx.query("supplier").count() == _suppliers(spark, d).count()
        tx.save("customer", [{"c_custkey": -1, "c_name": "new"}])
    try:
        with store.transaction() as tx:
            tx.remove("supplier", N.everything(), hard=True)
            raise KeyError("no")
    except KeyError:
        undone = store.query("supplier").count() > 0
    return _rows(spark, [(store.query("customer").count(), store.query("supplier").count(), store.manifest()["version"], undone, own)], "customers long, suppliers long, commits long, rolled_back boolean, own_writes boolean")


@registered("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 3 <> 0")
def store_over_other_tables(spark, d):
    """A store whose tables are kept by another class: here as ORC files elsewhere."""
    store = Store(spark, _place(spark), [CUSTOMER], tables=Tables(spark, _place(spark), "orc"))
    store.save("customer", _customers(spark, d))
    store.remove("customer", _mod(3), hard=True)
    store.models["customer"] = Model("customer", {n: replace(p, unique=False) for n, p in CUSTOMER.properties.items()}, key="c_custkey", soft_delete="deletedAt")
    store.patch_where("customer", _mod(2), {"c_name": patch.set_("even")})
    return store.query("customer").frame().select("c_custkey", "c_name")


@registered("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation ORDER BY 1")
def store_each_row(spark, d):
    nation = Model("nation", {"n_nationkey": integer(), "n_name": text()}, key="n_nationkey")
    store, seen = Store(spark, _place(spark), [nation]), []
    store.save("nation", _table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"))
    store.query("nation").sort("n_nationkey").each(lambda r: seen.append((r["n_nationkey"], r["n_name"])))
    return _rows(spark, seen, "k long, name string")


@registered("SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def store_ttl_vacuum(spark, d):
    model = Model("session", {"c_custkey": integer(), "seen": date()}, key="c_custkey", indexes=(Index(("seen",), ttl_seconds=3600), Index(("c_custkey",), unique=True)))
    store = Store(spark, _place(spark), [model])
    age = F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(7200)
    store.save("session", _customers(spark, d).select("c_custkey", (F.current_timestamp() - F.make_interval(secs=age)).alias("seen")))
    store.vacuum()
    return store.query("session").frame().select("c_custkey")


@registered("SELECT c_custkey, c_acctbal, (c_acctbal * 100)::BIGINT AS cents FROM customer")
def store_custom_codec(spark, d):
    cents = scalar(T.LongType(), encode=lambda v: round(v * 100), decode=lambda c: c / 100)
    model = Model("account", {"c_custkey": integer(), "c_acctbal": cents}, key="c_custkey")
    store = Store(spark, _place(spark), [model])
    store.save("account", _customers(spark, d).select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("c_acctbal")))
    return store.query("account").frame().select("c_custkey", "c_acctbal").join(store.table("account").select("c_custkey", F.col("c_acctbal").alias("cents")), "c_custkey")


@registered("SELECT i::VARCHAR AS k, 'name ' || i AS name, 'x' AS kind FROM range(1, 101) t(i)")
def seeded_rows(spark, d):
    step = sequence()
    model = Model("seed", {"k": text(), "n": integer(), "kind": text(default="x")}, key="k")
    built = Factory(model, {"n": step}).build(100)
    built = [r | {"k": str(r["n"])} for r in built]
    return model.frame(spark, built).select("k", F.concat(F.lit("name "), "n").alias("name"), "kind")


# relations kept in a store
@registered("""SELECT r_regionkey::VARCHAR AS region, coalesce(string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey::VARCHAR) FILTER (WHERE n_nationkey <> 3), '') AS nations
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def inverse_relation_kept(spark, d):
    region = Model("region", {"r": text(), "nations": to_many("nation")}, key="r")
    nation = Model("nation", {"n": text(), "region": to_one("region", inverse="nations")}, key="n")
    store = Store(spark, _place(spark), [region, nation])
    store.save("region", _table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("r"), F.array().cast("array<string>").alias("nations")))
    store.save("nation", _table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("n"), F.col("n_regionkey").cast("string").alias("region")))
    store.save("nation", [{"n": "3", "region": None}])  # leaves its region
    return store.query("region").frame().select(F.col("r").alias("region"), F.array_join(F.array_sort("nations"), ",").alias("nations"))


@registered("SELECT o_orderkey, c_name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def rel_load_embedded(spark, d):
    shape = T.StructType([T.StructField("name", T.StringType()), T.StructField("segment", T.StringType())])
    order = Model("order", {"o_orderkey": integer(), "buyer": to_one("customer", embed=shape)}, key="o_orderkey")
    rows = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("buyer"))
    out = Catalog().add(order, rows).query("order").select({"o_orderkey": True, "buyer": {"name": True, "segment": True}})
    return out.select("o_orderkey", F.col("buyer.name").alias("c_name"), F.col("buyer.segment").alias("segment"))


@registered("""SELECT o_orderkey, c_name, n_name AS nation, CASE WHEN o_orderkey % 2 = 0 THEN 'none' ELSE n_name || ',' || (SELECT n_name FROM nation WHERE n_nationkey = 0) END AS stops
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def rel_inside_embedded(spark, d):
    """References inside of an embedded document, and inside of an array of them, are followed."""
    shape = T.StructType([T.StructField("name", T.StringType()), T.StructField("nation", T.IntegerType())])
    nation = Model("nation", {"n_nationkey": _int(), "n_name": text()}, key="n_nationkey")
    buyer = Model("buyer", {"name": text(), "nation": to_one("nation")}, key="name")
    order = Model("order", {"o_orderkey": integer(), "buyer": to_one("buyer", embed=shape), "stops": to_many("buyer", embed=shape)}, key="o_orderkey")
    one = lambda name, k: F.struct(name.alias("name"), k.alias("nation"))
    stops = F.when(F.col("o_orderkey") % 2 == 1, F.array(one(F.lit("a"), F.col("c_nationkey")), one(F.lit("b"), F.lit(0)))).otherwise(F.array().cast(T.ArrayType(shape)))
    rows = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", one(F.col("c_name"), F.col("c_nationkey")).alias("buyer"), stops.alias("stops"))
    c = Catalog().add(order, rows).add(buyer, spark.createDataFrame([], "name string, nation int")).add(nation, _table(spark, d, "nation"))
    out = c.query("order").select({"o_orderkey": True, "buyer": {"name": True, "nation": {"n_name": True}}, "stops": {"nation": {"n_name": True}}})
    names = F.array_join(F.transform("stops", lambda x: x["nation"]["n_name"]), ",")
    return out.select("o_orderkey", F.col("buyer.name").alias("c_name"), F.col("buyer.nation.n_name").alias("nation"), F.when(F.size("stops") == 0, "none").otherwise(names).alias("stops"))


# predicates and plans in their JSON form
@registered("SELECT c_custkey FROM customer WHERE (c_acctbal > 100 OR c_mktsegment = 'BUILDING') AND NOT (c_name LIKE '%7') ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def plan_from_json(spark, d):
    where = N.And((N.Or((N.gt("c_acctbal", 100), N.eq("c_mktsegment", "BUILDING"))), N.Not(N.ends_with("c_name", "7"))))
    plan = {"model": "customer", "where": where.to_json(), "order": [["c_acctbal", True]], "paging": {"start": 0, "end": 1000}}
    c = Catalog().add(CUSTOMER, _customers(spark, d))
    return from_plan(c, plan, allowed=["customer"], max_page=40).frame().select("c_custkey")


@registered("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 31")
def keyset_date_cursor(spark, d):
    q = _q(spark, d, "orders").filter(N.lt("o_orderdate", datetime(1997, 1, 1))).sort("o_orderdate", True)
    one, two = q.page(10), None
    rows = list(one.rows)
    while one.cursor and len(rows) < 30:
        one = q.page(10, one.cursor)
        rows += one.rows
    two = q.page(1, one.cursor).rows if one.cursor else []
    return _rows(spark, [(r["o_orderkey"],) for r in [*rows, *two]], "o_orderkey long")


@registered("SELECT p_partkey FROM part WHERE list_contains(list_transform(string_split(p_name, ' '), lambda w: length(w) > 5), true)")
def doc_filter_elem_match(spark, d):
    return _q(spark, d, "shaped").where({"parts": {"$elemMatch": {"n": {"$gt": 5}}}}).frame().select("p_partkey")


@registered("SELECT c_custkey, c_custkey % 2 = 1 AS odd FROM customer")
def doc_filter_empty_and_generic(spark, d):
    q = _q(spark, d, "customer")
    everything, odd = q.where({}).frame().select("c_custkey"), q.filter(_mod(2, 1)).frame().select("c_custkey", F.lit(True).alias("odd"))
    return everything.join(odd, "c_custkey", "left").select("c_custkey", F.coalesce("odd", F.lit(False)).alias("odd"))


@registered("SELECT c_mktsegment AS _id, count(*) AS n, round(max(c_acctbal), 2) AS top FROM customer GROUP BY 1")
def doc_group_count(spark, d):
    return documents.pipeline(Catalog().add(CUSTOMER, _customers(spark, d)), "customer", [{"$group": {"_id": "$c_mktsegment", "n": {"$count": {}}, "top": {"$max": "$c_acctbal"}}}]).withColumn("top", F.round("top", 2))


# collections
@registered("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 2 + 3 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
CASE WHEN c_custkey = 10 THEN 'ten' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 'y,z' ELSE c_mktsegment END AS tags, c_custkey = 10 AS dated FROM customer
UNION ALL SELECT -2, 4.5, NULL, 'two', 'i', false UNION ALL SELECT -3, 1.0, NULL, 'three', '', false""")
def collection_updates(spark, d):
    c = Collection(_store(spark, d), "customer")
    fifth = {"c_acctbal": {"$gte": -1e9}, "$or": [{"c_custkey": k} for k in (10,)]}
    with c.store.transaction():
        c.store.patch_where("customer", _mod(5), {"c_mktsegment": patch.set_("fifth")})
        c.update_many({"c_mktsegment": "fifth"}, {"$mul": {"c_acctbal": 2}, "$unset": {"c_nationkey": 1}, "$set": {"tags": ["x", "y"]}})
        c.update_many({"c_mktsegment": "fifth"}, {"$inc": {"c_acctbal": 3}, "$push": {"tags": {"$each": ["z", "q"]}}})
        c.update_many({"c_mktsegment": "fifth"}, {"$addToSet": {"tags": "z"}})
        c.update_many({"c_mktsegment": "fifth"}, {"$pull": {"tags": "x"}})
        c.update_many({"c_mktsegment": "fifth"}, {"$pullAll": {"tags": ["q"]}})
        c.update_one(fifth, {"$set": {"c_name": "ten"}})
        c.insert_one({"c_custkey": -3, "c_name": "three", "c_acctbal": 1.0, "tags": []})
    c.update_one({"c_custkey": -2}, {"$set": {"c_name": "two", "c_acctbal": 4.5}, "$setOnInsert": {"tags": ["i"]}}, upsert=True)
    stamped = Collection(Store(spark, _place(spark), [Model("stamp", {"k": integer(), "at": date()}, key="k")]), "stamp")
    stamped.insert_many([{"k": 10}, {"k": 11}])
    stamped.update_one({"k": 10}, {"$currentDate": {"at": True}})
    at = {r["k"]: r["at"] is not None for r in stamped.find().list()}
    return c.find().frame().select("c_custkey", "c_acctbal", "c_nationkey", "c_name", F.array_join("tags", ",").alias("tags"), (F.col("c_custkey") == 10).alias("dated") if at == {10: True, 11: False} else F.lit(None).alias("dated"))


@registered("""SELECT c_custkey, CASE WHEN c_custkey = 4 THEN 'four' WHEN c_custkey = 9 THEN 'nine' ELSE c_name END AS c_name, CASE WHEN c_custkey = 4 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey NOT IN (5, 6) AND c_acctbal >= 0""")
def collection_replace_and_delete(spark, d):
    c = Collection(_store(spark, d), "customer")
    old = c.find_one({"c_custkey": 4})["c_acctbal"]
    c.replace_one({"c_custkey": 4}, {"c_name": "four", "c_acctbal": old})
    c.delete_one({"c_custkey": {"$in": [5]}})
    c.delete_one({"c_custkey": 6})
    c.delete_many({"c_acctbal": {"$lt": 0}})
    c.find_one_and_update({"c_custkey": 9}, {"$set": {"c_name": "nine"}})
    return c.find({}, sort={"c_custkey": 1}).frame().select("c_custkey", "c_name", "c_mktsegment")


@registered("SELECT (SELECT count(*) FROM customer) + 2 AS n, 'made' AS made, 'many' AS many, true AS nothing_before, (SELECT c_name FROM customer WHERE c_custkey = 3) AS before_it")
def collection_upserts(spark, d):
    c = Collection(_store(spark, d), "customer")
    made = c.find_one_and_update({"c_custkey": -7}, {"$set": {"c_name": "made"}}, upsert=True)
    c.update_many({"c_custkey": -8}, {"$set": {"c_name": "many"}}, upsert=True)
    nothing = c.find_one_and_update({"c_custkey": -99}, {"$set": {"c_name": "no"}}) is None
    before = c.find_one_and_update({"c_custkey": 3}, {"$set": {"c_name": "three"}}, after=False)["c_name"]
    return _rows(spark, [(c.count_documents(), made["c_name"], c.find_one({"c_custkey": -8})["c_name"], nothing, before)], "n long, made string, many string, nothing_before boolean, before_it string")


# policies
@registered("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0)")
def policy_writes(spark, d):
    store = _store(spark, d, policy=lambda m: N.eq("c_mktsegment", "BUILDING"))
    store.patch_where("customer", _mod(2), {"c_acctbal": patch.set_(0.0)})
    store.remove("customer", _mod(3), hard=True)
    return store.table("customer").select("c_custkey", "c_acctbal")


@registered("""SELECT c_custkey, 'found' AS how FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT count(*)::BIGINT, 'counted' FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT count(*)::BIGINT, 'piped' FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT count(*)::BIGINT, 'updated' FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT count(*)::BIGINT, 'planned' FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT count(*)::BIGINT, 'sql' FROM customer WHERE c_mktsegment = 'BUILDING'""")
def policy_on_collections(spark, d):
    policy = lambda m: N.eq("c_mktsegment", "BUILDING")
    store = _store(spark, d, policy=policy)
    c = Collection(store, "customer")
    out = [(c.count_documents(), "counted"), (c.aggregate([{"$count": "n"}]).first()["n"], "piped"), (from_plan(store.catalog, {"model": "customer", "where": N.All().to_json()}, policy=policy).count(), "planned"), (store.sql("SELECT count(*) AS n FROM customer").first()["n"], "sql")]
    out.append((c.update_many({}, {"$inc": {"c_acctbal": 1}}), "updated"))
    return c.find().frame().select("c_custkey", F.lit("found").alias("how")).union(_rows(spark, out, "n long, how string"))


@registered("SELECT 'hidden row' AS what, true AS refused UNION ALL SELECT 'denied write', true UNION ALL SELECT 'unique key', true UNION ALL SELECT 'other writer', true")
def store_refuses(spark, d):
    store = _store(spark, d)

    def other_writer() -> None:
        mine = Store(spark, store.path, [CUSTOMER])

        def between(model: Model, df: DataFrame) -> DataFrame:
            mine.hooks.clear()
            Store(spark, store.path, [CUSTOMER]).save("customer", [{"c_custkey": -4, "c_name": "b"}])
            return df

        mine.hooks["before_commit"] = between
        mine.save("customer", [{"c_custkey": -5, "c_name": "a"}])

    def hidden() -> None:
        store.policy = lambda m: N.gt("c_custkey", 1_000_000_000)
        try:
            store.save("customer", [{"c_custkey": 1, "c_name": "mine now"}])
        finally:
            store.policy = None

    def denied() -> None:
        store.can_write = lambda m, rows: False
        try:
            store.save("customer", [{"c_custkey": -6, "c_name": "x"}])
        finally:
            store.can_write = None

    name = store.query("customer").get(1)["c_name"]
    cases = {"hidden row": (hidden, WriteDenied), "denied write": (denied, WriteDenied), "unique key": (lambda: store.save("customer", [{"c_custkey": -1, "c_name": name}]), UniqueViolation), "other writer": (other_writer, Conflict)}
    return _refusals(spark, cases)


def _refusals(spark: SparkSession, cases: dict[str, tuple[Callable, type[Exception]]]) -> DataFrame:
    out = []
    for what, (run, kind) in cases.items():
        try:
            run()
            out.append((what, False))
        except kind:
            out.append((what, True))
    return _rows(spark, out, "what string, refused boolean")


@registered("SELECT what, true AS refused FROM (VALUES ('bounds'), ('end before start'), ('page of none'), ('cursor of another order'), ('sort by computed'), ('filter by computed'), ('stage'), ('accumulator'), ('operator'), ('regular expression'), ('empty update'), ('replacement as update'), ('two updates of a field'), ('no such model'), ('private model'), ('two migrations of a name'), ('migration without down'), ('nested transaction'), ('identifier'), ('required'), ('type'), ('variant path')) t(what)")
def guards(spark, d):
    q, c = _q(spark, d, "customer"), _q(spark, d, "customer").catalog
    cursor = q.sort("c_name").page(1).cursor
    store = Store(spark, _place(spark), [CUSTOMER])

    def nested() -> None:
        with store.transaction(), store.transaction():
            pass

    m = migrate.Migration("m", lambda s: None)
    cases = {
        "bounds": (lambda: q.slice(-1, 3), ValueError), "end before start": (lambda: q.slice(3, 1), ValueError), "page of none": (lambda: q.page(0), ValueError),
        "cursor of another order": (lambda: q.sort("c_acctbal").page(1, cursor), ValueError), "sort by computed": (lambda: q.sort("label"), ValueError), "filter by computed": (lambda: q.filter(N.eq("label", "x")).rows(), ValueError),
        "stage": (lambda: documents.pipeline(c, "customer", [{"$lookup": {}}]), Unsupported), "accumulator": (lambda: documents.pipeline(c, "customer", [{"$group": {"_id": None, "x": {"$first": "$c_name"}}}]), Unsupported),
        "operator": (lambda: q.where({"c_name": {"$type": 2}}), Unsupported), "regular expression": (lambda: q.where({"c_name": {"$regex": "a.*b"}}), Unsupported),
        "empty update": (lambda: documents.parse_update({}), Unsupported), "replacement as update": (lambda: documents.parse_update({"a": 1}), Unsupported), "two updates of a field": (lambda: documents.parse_update({"$set": {"a": 1}, "$inc": {"a": 1}}), Unsupported),
        "no such model": (lambda: from_plan(c, {"model": "nothing", "where": N.All().to_json()}), PermissionError), "private model": (lambda: from_plan(c, {"model": "_migrations", "where": N.All().to_json()}), PermissionError),
        "two migrations of a name": (lambda: migrate.migrate(store, [m, m]), ValueError), "migration without down": (lambda: (migrate.migrate(store, [m]), migrate.rollback(store, [m])), ValueError),
        "nested transaction": (nested, RuntimeError), "identifier": (lambda: Model("a; DROP", {}), ValueError), "required": (lambda: Model("r", {"a": text(required=True)}).instance({}), ValidationError), "type": (lambda: Model("r", {"a": integer()}).instance({"a": "x"}), ValidationError),
        "variant path": (lambda: Catalog().add(Model("v", {"v": embedded()}, key="k"), spark.range(1).select(F.col("id").cast("string").alias("k"), F.parse_json(F.lit("{}")).alias("v"))).query("v").filter(N.eq("v.a'b", 1)).rows(), ValueError),
    }
    return _refusals(spark, cases)


# migrations
@registered("SELECT c_custkey, c_name AS full_name, 3::BIGINT AS stars, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def migrate_columns(spark, d):
    store = _store(spark, d)
    steps = [
        migrate.Migration("1 stars", lambda s: s.add_column("customer", "stars", T.LongType(), 3), lambda s: s.drop_column("customer", "stars")),
        migrate.Migration("2 names", lambda s: (s.rename_column("customer", "c_name", "full_name"), s.create_index("customer", ["full_name"])), lambda s: s.rename_column("customer", "full_name", "c_name")),
        migrate.Migration("3 types", lambda s: s.alter_column_type("customer", "c_nationkey", T.StringType())),
        migrate.Migration("4 backfill", lambda s: (s.drop_column("customer", "tags"), s.sql("customer", "SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM customer"))),
    ]
    store.models["customer"] = Model("customer", {n: p for n, p in CUSTOMER.properties.items() if n not in ("c_name",)}, key="c_custkey", soft_delete="deletedAt")
    ran, again = migrate.migrate(store, steps), migrate.migrate(store, steps)
    out = spark.read.parquet(f"{store.path}/customer/{store.manifest()['tables']['customer']}")
    return out.select("c_custkey", "full_name", "stars", "parity", "c_nationkey").filter(F.lit(len(ran) == 4 and again == []))


@registered("SELECT 'created,filled' AS ran, 'filled,created' AS undone, (SELECT count(*) FROM supplier) AS filled, true AS dropped, 0::BIGINT AS tracked")
def migrate_and_rollback(spark, d):
    store = Store(spark, _place(spark), [])
    steps = [
        migrate.Migration("created", lambda s: s.create_table(SUPPLIER), lambda s: s.drop_table("supplier")),
        migrate.Migration("filled", lambda s: s.store.save("supplier", _suppliers(spark, d)), lambda s: s.store.remove("supplier", N.everything(), hard=True)),
    ]
    ran = migrate.migrate(store, steps)
    filled = store.query("supplier").count()
    undone = migrate.rollback(store, steps, 2)
    return _rows(spark, [(",".join(ran), ",".join(undone), filled, "supplier" not in store.manifest()["tables"], store.table("_migrations").count())], "ran string, undone string, filled long, dropped boolean, tracked long")


# copies
@registered("SELECT c_custkey, lower(c_name) AS c_name FROM customer WHERE c_acctbal > 0")
def copy_between_stores(spark, d):
    source, target, seen = _store(spark, d), Store(spark, _place(spark), [CUSTOMER]), []
    n = source.query("customer").count()
    io.copy(source, target, ["customer"], N.gt("c_acctbal", 0), lambda df: df.withColumn("c_name", F.lower("c_name")), batch=-(-n // 2), on_batch=lambda model, k: seen.append(k))
    ok = seen == sorted(seen) and 1 <= len(seen) <= 2
    return target.query("customer").frame().select("c_custkey", "c_name").filter(F.lit(ok))


@registered("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE c_acctbal END AS c_acctbal, 2::BIGINT AS stores FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT -1, NULL, 2")
def fan_out_writes(spark, d):
    stores = [Store(spark, _place(spark), [CUSTOMER]) for _ in range(2)]
    both = io.FanOut(stores)
    both.save("customer", _customers(spark, d))
    both.patch_where("customer", _mod(2), {"c_acctbal": patch.set_(1.0)})
    both.remove("customer", _mod(3), hard=True)
    both.upsert("customer", N.eq("c_custkey", -1), {"c_name": patch.set_("new")})
    rows = stores[0].table("customer").union(stores[1].table("customer"))
    return rows.groupBy("c_custkey", "c_acctbal").agg(F.count("*").alias("stores"))


@registered("SELECT c_custkey::VARCHAR AS k, c_name AS name, c_nationkey::VARCHAR AS nation, c_acctbal AS balance, c_mktsegment || ',' || c_custkey AS tags, 't' || c_custkey AS follows FROM customer")
def import_json_export(spark, d):
    model = Model("doc", {"k": text(), "name": text(), "balance": float_(), "nation": to_one("nation"), "follows": to_many("doc"), "tags": array()}, key="k")
    key = lambda c: F.struct(c.cast("string").alias("$oid"))
    exported = _table(spark, d, "customer").select(F.to_json(F.struct(key(F.col("c_custkey")).alias("_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), key(F.col("c_nationkey")).alias("nation"), F.array(key(F.concat(F.lit("t"), F.col("c_custkey")))).alias("follows"), F.array("c_mktsegment", F.col("c_custkey").cast("string")).alias("tags"))).alias("value"))
    path = _place(spark)
    exported.write.text(path)
    return io.json_lines(spark, path, model, "_id").select("k", "name", "nation", "balance", F.array_join("tags", ",").alias("tags"), F.array_join("follows", ",").alias("follows"))


# feeds and live queries
@registered("""SELECT c_custkey::VARCHAR AS key, 'saved' AS kind, NULL AS before, c_name AS after FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'saved', c_name, 'even' || c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey::VARCHAR, 'removed', CASE WHEN c_custkey % 2 = 0 THEN 'even' || c_custkey ELSE c_name END, NULL FROM customer WHERE c_custkey % 3 = 0""")
def change_feed(spark, d):
    store = _store(spark, d)
    store.patch_where("customer", _mod(2), {"c_name": patch.set_(N.concat("even", N.field("c_custkey")))})
    store.remove("customer", _mod(3), hard=True)
    log = store.changes()
    numbered = log.agg(F.count("*") == F.max("seq"), F.countDistinct("seq") == F.max("seq")).first()
    return log.filter(F.lit(all(numbered))).select("key", "kind", F.get_json_object("before", "$.c_name").alias("before"), F.get_json_object("after", "$.c_name").alias("after"))


@registered("SELECT c_custkey::VARCHAR AS key, 'seen' AS how FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT count(*)::VARCHAR, 'told' FROM customer WHERE c_acctbal > 5000")
def change_feed_where(spark, d):
    store, told = Store(spark, _place(spark), [CUSTOMER]), []
    rich = N.gt("c_acctbal", 5000)
    store.subscribe(lambda name, rows: told.append(rows.count()), "customer", rich)
    store.save("customer", _customers(spark, d))
    store.save("customer", [{"c_custkey": -1, "c_name": "poor", "c_acctbal": 1.0}])
    return matching(store.changes(), CUSTOMER, rich).select("key", F.lit("seen").alias("how")).union(_rows(spark, [(str(n), "told") for n in told], "key string, how string"))


@registered("SELECT c_custkey::VARCHAR AS key FROM customer WHERE c_mktsegment = 'BUILDING'")
def change_stream_under_policy(spark, d):
    store = _store(spark, d)
    store.remove("customer", _mod(2), hard=True)  # removals can't be judged and aren't shown
    name = f"feed_{uuid.uuid4().hex}"
    stream = live.change_stream(store, "customer", visible=N.eq("c_mktsegment", "BUILDING")).select("key").writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.table(name)


@registered("SELECT 0::BIGINT AS turn, 0::BIGINT AS n UNION ALL SELECT 1, count(*) FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 2, 0 UNION ALL SELECT 10, 0 UNION ALL SELECT 11, count(*) FROM supplier")
def live_query_turns(spark, d):
    nation = Model("nation", {"n_nationkey": integer(), "n_name": text()}, key="n_nationkey")
    supplier = Model("supplier", dict(SUPPLIER.properties) | {"s_nationkey": to_one("nation", embed=None)}, key="s_suppkey")
    supplier.properties["s_nationkey"].__dict__["type"] = T.LongType()
    store = Store(spark, _place(spark), [CUSTOMER, supplier, nation])
    got: list[tuple[int, int]] = []
    query = live.LiveQuery(store, store.query("customer").filter(N.gt("c_acctbal", 5000)), lambda q: q.count())
    stop = query.subscribe(lambda n: got.append((len(got), n)))  # before the first commit
    store.save("customer", _customers(spark, d))
    query.drain()
    store.save("supplier", _suppliers(spark, d))  # of another model: nothing happens
    query.drain()
    store.patch_where("customer", N.everything(), {"c_acctbal": patch.set_(0.0)})
    query.drain()
    stop()
    related: list[tuple[int, int]] = []
    query = live.LiveQuery(store, store.query("supplier").filter(N.neq("s_nationkey.n_name", "")), lambda q: q.count())
    stop = query.subscribe(lambda n: related.append((10 + len(related), n)))
    store.save("nation", _table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"))
    query.drain()
    stop()
    return _rows(spark, got + related, "turn long, n long")


@registered("SELECT 'same until a commit' AS what, true AS ok UNION ALL SELECT 'fresh after it', true UNION ALL SELECT 'handshake of equal models', true UNION ALL SELECT 'handshake of others', false")
def cached_results_and_handshake(spark, d):
    store = _store(spark, d)
    q = lambda: store.query("customer").filter(N.gt("c_acctbal", 0))
    first = store.cached(q())
    same = store.cached(q()) is first
    store.save("customer", [{"c_custkey": -1, "c_name": "new", "c_acctbal": 1.0}])
    fresh = store.cached(q()) is not first
    turned = Model("customer", dict(reversed(CUSTOMER.properties.items())), key="c_custkey", soft_delete="deletedAt")
    return _rows(spark, [("same until a commit", same), ("fresh after it", fresh), ("handshake of equal models", store.fingerprint() == fingerprint([SUPPLIER, turned])), ("handshake of others", store.fingerprint() == fingerprint([SUPPLIER]))], "what string, ok boolean")


@registered("SELECT c_custkey, upper(c_name) || '!' AS c_name FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT -1, 'save,saved,remove,removed 2'")
def hooks_and_observers(spark, d):
    calls: list[str] = []
    seen: list[dict] = []
    hooks = {
        "before_save": lambda m, rows: (calls.append("save"), rows.withColumn("c_name", F.upper("c_name")))[1], "after_save": lambda m, rows: calls.append("saved"),
        "before_remove": lambda m, where: (calls.append("remove"), where)[1], "after_remove": lambda m, where: calls.append("removed"),
        "before_commit": lambda m, df: df.withColumn("c_name", F.concat(F.rtrim("c_name", F.lit("!")), F.lit("!"))),
    }
    store = Store(spark, _place(spark), [CUSTOMER], hooks=hooks, observe=seen.append)
    store.save("customer", _customers(spark, d))
    store.remove("customer", _mod(2), hard=True)
    return store.table("customer").select("c_custkey", "c_name").union(_rows(spark, [(-1, f"{','.join(calls)} {len(seen)}")], "k long, n string"))


@registered("SELECT 'retried' AS what, 3::BIGINT AS n UNION ALL SELECT 'observed rows', (SELECT count(*) FROM nation) UNION ALL SELECT 'timed out', 1 UNION ALL SELECT 'transaction again', 2")
def resilience(spark, d):
    tries: list[int] = []
    reports: list[dict] = []

    def flaky() -> list:
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return _table(spark, d, "nation").collect()

    observed("read", lambda: retried(flaky, sleep=lambda s: None), reports.append)
    try:
        late = within(0.05, lambda: threading_sleep(2)) or 0
    except TimeoutError:
        late = 1
    store, turns = Store(spark, _place(spark), [CUSTOMER]), []

    def body(tx: Store) -> None:
        turns.append(1)
        if len(turns) == 1:  # another writer comes between
            raise Conflict("once")
        tx.save("customer", [{"c_custkey": 1, "c_name": "a"}])

    transacted(store, body, sleep=lambda s: None)
    return _rows(spark, [("retried", len(tries)), ("observed rows", reports[0]["rows"]), ("timed out", late), ("transaction again", len(turns))], "what string, n long")


def threading_sleep(seconds: float) -> None:
    import time

    time.sleep(seconds)


# replication
@registered("SELECT * FROM (VALUES (1, '000000000001000:000000:n'), (2, '000000000001000:000001:n'), (3, '000000000005000:000004:n'), (4, '000000000009000:000000:n')) t(i, stamp)")
def clock_stamps(spark, d):
    now = [1000]
    clock, out = sync.Clock("n", lambda: now[0]), []
    out += [clock.now(), clock.now()]
    clock.update("000000000005000:000002:m")
    clock.update("nonsense")
    out.append(clock.now())
    now[0] = 9000
    out.append(clock.now())
    return _rows(spark, list(enumerate(out, 1)), "i int, stamp string")


@registered("""SELECT r_name AS replica, n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 5 = 1 THEN 'A' ELSE n_name END AS title, CASE WHEN n_nationkey % 5 = 1 THEN 'B' ELSE 'x' END AS body
FROM nation, (VALUES ('a'), ('b'), ('restarted')) r(r_name) WHERE n_nationkey % 5 <> 2""")
def sync_replicas_by_field(spark, d):
    """Edits of different fields both survive, a removal beats an earlier edit (2) and loses to a later one (3)."""
    at = [1000]

    def tick() -> int:
        at[0] += 1
        return at[0]

    store = Store(spark, _place(spark), [])
    server = sync.StoreTarget(store, by_field=True)
    a, b = (sync.Replica(sync.Clock(n, tick), server) for n in "ab")
    nations = {str(r["n_nationkey"]): r["n_name"] for r in _table(spark, d, "nation").collect()}
    for k, name in nations.items():
        a.save("nation", k, {"title": name, "body": "x"})
    a.sync()
    b.sync()
    for k, name in nations.items():
        if int(k) % 5 == 1:
            a.save("nation", k, {"title": "A", "body": "x"})
            b.save("nation", k, {"title": name, "body": "B"})
        elif int(k) % 5 == 2:
            a.save("nation", k, {"title": "lost", "body": "x"})
            b.remove("nation", k)
        elif int(k) % 5 == 3:
            b.remove("nation", k)
            a.save("nation", k, {"title": name, "body": "x", "kept": 1})
    for r in (a, b, a, b):
        r.sync()
    again = sync.StoreTarget(Store(spark, store.path, []), by_field=True)  # a restart: the log is there and the numbers go on
    c = sync.Replica(sync.Clock("c", tick), again)
    c.sync()
    fold = sync.merge_fields(again.frame(spark)).select(F.lit("restarted").alias("replica"), "key", F.try_element_at("record", F.lit("title")).alias("title"), F.try_element_at("record", F.lit("body")).alias("body"))
    rows = [(n, k, x["title"], x["body"]) for n, r in (("a", a), ("b", b)) for k in nations if (x := r.get("nation", k)) is not None]
    same = all((c.get("nation", k) or {}) == (a.get("nation", k) or {}) for k in nations)
    return _rows(spark, rows, "replica string, key string, title string, body string").union(fold).filter(F.lit(same))


@registered("""WITH s AS (SELECT user_id, event_type, event_id * 7919 % 10007 AS ver FROM events)
SELECT user_id::VARCHAR AS key, max(ver) FILTER (WHERE event_type = 'error') IS NOT NULL AS had_removal FROM s GROUP BY 1
HAVING max(ver) FILTER (WHERE event_type <> 'error') > coalesce(max(ver) FILTER (WHERE event_type = 'error'), -1)""")
def sync_tombstones(spark, d):
    from marrow.catalog import _changes

    changes = _changes(spark, d)
    removed = changes.filter("kind = 'removed'").select("key").distinct().withColumn("had", F.lit(True))
    return sync.merge_fields(changes).join(removed, "key", "left").select("key", F.col("had").isNotNull().alias("had_removal"))


@registered("SELECT 2::BIGINT AS log, 1::BIGINT AS conflicts, 3::BIGINT AS next_seq, 'second' AS winner")
def sync_push_conflicts(spark, d):
    store = Store(spark, _place(spark), [])
    target = sync.StoreTarget(store)
    change = lambda v, n: {"model": "m", "key": "k", "kind": "saved", "record": {"n": n}, "version": v, "fields": None}
    conflicts = target.push([change("2", "second")]) + target.push([change("1", "first")]) + target.push([change("3", "second")])
    again = sync.StoreTarget(Store(spark, store.path, []))
    log, cursor = again.pull()
    return _rows(spark, [(len(log), len(conflicts), again.seq + 1, log[-1]["record"]["n"])], "log long, conflicts long, next_seq long, winner string")
