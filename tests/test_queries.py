import os
from datetime import datetime

import duckdb
import pytest

from marrow import catalog, catalog_store  # noqa: F401  (registers its queries)
from marrow.functions import nodes as N
from marrow.operators import documents
from marrow.operators import query as Q
from marrow.operators.query import Catalog
from marrow.plans.docfilter import Unsupported
from marrow.schema import Factory, Model, ValidationError, computed, date, fingerprint, integer, sequence, text, to_many, to_one

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float):
        return round(float(v), 6)
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_registered_query_matches_its_sql(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    a = sorted(([_plain(x) for x in r] for r in want.fetchall()), key=key)
    b = sorted(([_plain(r[c]) for c in columns] for r in df.collect()), key=key)
    assert a == b


@pytest.fixture(scope="module")
def pay(spark):
    df = spark.createDataFrame([("a", "u1", 100), ("b", "u1", 300), ("c", "u1", 300), ("d", "u2", 50), ("e", "u2", 80)], "uuid string, user string, amount long")
    return Catalog().add(Model("pay", {"user": text(), "amount": integer()}), df)


def test_windows(pay):
    rows = pay.query("pay").sort("amount").windowed(["user"], n="rowNumber", r="rank", d="denseRank").collect()
    assert {r.uuid: (r.n, r.r, r.d) for r in rows} == {"a": (1, 1, 1), "b": (2, 2, 2), "c": (3, 2, 2), "d": (1, 1, 1), "e": (2, 2, 2)}
    assert {r.n for r in pay.query("pay").windowed([], n="denseRank").collect()} == {1}


def test_keyset_pages_see_every_row_once(spark):
    rows = [(f"u{i}", age) for i, age in enumerate([30, 30, 25, None, 30, 25, 18])]
    c = Catalog().add(Model("p", {"age": integer()}), spark.createDataFrame(rows, "uuid string, age long"))
    for descending in (False, True):
        q, cursor, seen = c.query("p").sort("age", descending), None, []
        while True:
            page = q.page(2, cursor)
            seen += [r.uuid for r in page.rows]
            if (cursor := page.cursor) is None:
                break
        assert seen == [r.uuid for r in q.list()] and len(set(seen)) == 7
    with pytest.raises(ValueError):
        c.query("p").page(2, c.query("p").sort("age").page(2).cursor)
    with pytest.raises(ValueError):
        c.query("p").page(0)


def test_order_and_bounds(spark):
    c = Catalog().add(Model("p", {"score": integer()}), spark.createDataFrame([("a", 2), ("b", None), ("c", 1)], "uuid string, score long"))
    assert [r.uuid for r in c.query("p").sort("score").list()] == ["b", "c", "a"]
    assert [r.uuid for r in c.query("p").sort("score", True).list()] == ["a", "c", "b"]
    assert [r.uuid for r in c.query("p").sort("score").slice(1, 2).list()] == ["c"]
    assert c.query("p").sort("score").slice(0, 1).count() == 3
    for bad in ((-1, 2), (2, 1), (0.5, 1)):
        with pytest.raises(ValueError):
            c.query("p").slice(*bad)


@pytest.fixture(scope="module")
def shop(spark):
    c = Catalog()
    c.add(Model("customer", {"name": text(), "country": text()}, soft_delete="deletedAt"), spark.createDataFrame([("c1", "Ada", "GB", None), ("c2", "Bo", "DE", None), ("c3", "Cy", "DE", datetime(2024, 1, 1))], "uuid string, name string, country string, deletedAt timestamp"))
    c.add(Model("item", {"sku": text(), "qty": integer()}), spark.createDataFrame([("i1", "x", 1), ("i2", "y", 2)], "uuid string, sku string, qty long"))
    orders = [("o1", "r1", "c1", ["i2", "gone", "i1"]), ("o2", "r2", "c2", []), ("o3", "r3", "c3", None), ("o4", "r4", None, ["i2"])]
    c.add(Model("order", {"ref": text(), "customer": to_one("customer"), "items": to_many("item"), "loud": computed(lambda df: df["ref"])}), spark.createDataFrame(orders, "uuid string, ref string, customer string, items array<string>"))
    return c


def _ids(q):
    return [r.uuid for r in q.sort("uuid").list()]


def test_relation_filters(shop):
    q = shop.query("order")
    assert _ids(q.filter(N.eq("customer.country", "DE"))) == ["o2"]  # o3's customer is softly deleted
    assert _ids(q.filter(N.eq("items.qty", 2))) == ["o1", "o4"]
    assert _ids(q.filter(N.or_(N.eq("customer.country", "GB"), N.eq("ref", "r4")))) == ["o1", "o4"]
    assert _ids(q.filter(N.not_(N.eq("customer.country", "GB")))) == ["o2", "o3", "o4"]
    assert _ids(shop.query("customer").include_deleted()) == ["c1", "c2", "c3"]


def test_relations_load_in_order(shop):
    rows = {r.uuid: r for r in shop.query("order").load("customer", "items").collect()}
    assert [i.sku for i in rows["o1"]["items"]] == ["y", "x"] and rows["o2"]["items"] == [] and rows["o3"].customer is None
    assert rows["o1"].customer.name == "Ada"
    nested = shop.query("order").select({"ref": True, "customer": {"name": True}, "n": N.concat(N.field("ref"), "!")})
    assert nested.columns == ["ref", "customer", "n"]


def test_computed_properties_are_not_searched(shop):
    with pytest.raises(ValueError):
        shop.query("order").sort("loud")
    with pytest.raises(ValueError):
        shop.query("order").filter(N.eq("loud", "r1")).list()


def test_semi_join_in_the_plan(shop):
    plan = shop.query("order").filter(N.eq("customer.country", "DE")).rows()._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_aggregates_of_nothing_and_nan(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 2.0), ("c", None)], "uuid string, x double")
    q = Catalog().add(Model("m", {"x": integer()}), df).query("m")
    r = q.aggregate(n=Q.count(), s=Q.sum_("x"), a=Q.avg("x"), lo=Q.min_("x"), d=Q.count_distinct("x"), t=Q.sum_("uuid")).first()
    assert (r.n, r.s, r.a, r.lo, r.t) == (3, 2.0, 2.0, 2.0, 0.0)
    r = q.filter(N.eq("uuid", "z")).aggregate(n=Q.count(), s=Q.sum_("x"), hi=Q.max_("x")).first()
    assert (r.n, r.s, r.hi) == (0, 0.0, 0.0)


def test_pipelines_refuse_what_they_lack(pay):
    assert documents.pipeline(pay, "pay", [{"$group": {"_id": None, "n": {"$sum": 1}}}]).first().n == 5
    for stages in ([{"$lookup": {}}], [{"$facet": {}}], [{"$group": {"_id": None, "n": {"$sum": 2}}}], [{"$unwind": "$a"}], [{"$project": {}}], [{"$group": {"_id": "$user", "x": {"$push": "$a"}}}]):
        with pytest.raises(Unsupported):
            documents.pipeline(pay, "pay", stages)
    for update in ({}, {"a": 1}, {"$set": {"a": 1}, "$inc": {"a": 1}}, {"$rename": {"a": "b"}}):
        with pytest.raises(Unsupported):
            documents.parse_update(update)


def test_models():
    m = Model("m", {"name": text(required=True), "n": integer(default=3), "at": date()}, timestamps=True)
    row = m.instance({"name": "x"})
    assert row["n"] == 3 and len(row["uuid"]) == 32 and row["createdAt"] is not None
    for bad in ({}, {"name": 5}, {"name": "x", "n": 1.5}):
        with pytest.raises(ValidationError):
            m.instance(bad)
    other = Model("m", dict(reversed(list(m.properties.items()))), timestamps=True)
    assert fingerprint([m]) == fingerprint([other]) != fingerprint([Model("m", {"name": text()})]) and len(fingerprint([m])) == 16
    assert [r["n"] for r in Factory(m, {"name": "x", "n": sequence()}).build(3)] == [1, 2, 3]


def test_plans_from_json(pay):
    q = pay.query("pay").filter(N.gt("amount", 60)).sort("amount", True)
    again = Q.from_plan(pay, q.plan(), allowed=["pay"], max_page=2)
    assert [r.uuid for r in again.list()] == ["b", "c"]
    assert q.digest() != again.digest() and q.digest() == pay.query("pay").filter(N.gt("amount", 60)).sort("amount", True).digest()
    for plan in ({"model": "_x", "where": {"node": "All"}}, {"model": "other", "where": {"node": "All"}}):
        with pytest.raises(PermissionError):
            Q.from_plan(pay, plan)


def test_policies_also_hold_for_relations(shop):
    hide = lambda m: N.eq("country", "GB") if m.name == "customer" else None
    q = shop.query("order", policy=hide)
    assert _ids(q.filter(N.eq("customer.country", "DE"))) == []
    assert {r.uuid: r.customer is None for r in q.load("customer").collect()}["o2"]


@pytest.mark.parametrize("functions", [{"n": "rowNumber"}, {"n": "rowNumber", "r": "rank", "d": "denseRank"}])
@pytest.mark.parametrize("sorts", [[], [("a", False)], [("a", True), ("b", False)]])
def test_ranks_without_a_partition(spark, functions, sorts):
    import random

    rng = random.Random(4)
    rows = [(f"k{i:03d}", rng.choice([None, 1, 2, 3, 9]), rng.choice([None, 0, 5])) for i in range(200)]
    q = Catalog().add(Model("m", {"a": integer(), "b": integer()}), spark.createDataFrame(rows, "uuid string, a long, b long").repartition(5)).query("m")
    for name, down in sorts:
        q = q.sort(name, down)
    got = {r["uuid"]: r for r in q.windowed([], **functions).collect()}
    place = lambda v, down: (v is None, -v if v is not None else 0) if down else (v is not None, v or 0)
    at = lambda r: tuple(place(r["ab".index(n) + 1], d) for n, d in sorts)
    ordered = sorted(rows, key=lambda r: (at(r), r[0]))
    groups = sorted({at(r) for r in rows})
    for i, r in enumerate(ordered, 1):
        want = {"rowNumber": i, "rank": 1 + sum(at(x) < at(r) for x in rows), "denseRank": 1 + groups.index(at(r))}
        assert {n: got[r[0]][n] for n in functions} == {n: want[fn] for n, fn in functions.items()}
    assert q.filter(N.eq("uuid", "none")).windowed([], **functions).count() == 0
