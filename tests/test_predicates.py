import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.functions import nodes as N
from marrow.operators.query import Catalog
from marrow.plans import compiler, docfilter
from marrow.plans.compiler import Scope
from marrow.schema import Model, array, float_, integer, text
from tests.oracle import holds

ROWS = [
    {"uuid": "a", "name": "Ann", "age": 20, "score": 1.5, "tags": ["x", "y"], "address": {"city": "NYC", "zip": 1}},
    {"uuid": "b", "name": "Bo", "age": None, "score": None, "tags": None, "address": None},
    {"uuid": "c", "name": "Cy", "age": None, "score": 0.0, "tags": [], "address": {"city": None, "zip": 2}},
    {"uuid": "d", "name": None, "age": 40, "score": -2.0, "tags": ["y", "y"], "address": {"city": "LA", "zip": None}},
    {"uuid": "e", "name": "É%", "age": 0, "score": 20.0, "tags": ["z"], "address": {"city": "nyc", "zip": 3}},
]
SCHEMA = "uuid string, name string, age long, score double, tags array<string>, address struct<city: string, zip: long>"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([tuple(r[k] for k in ("uuid", "name", "age", "score", "tags", "address")) for r in ROWS], SCHEMA).cache()


def found(people, p):
    return sorted(r.uuid for r in people.filter(compiler.predicate(p, Scope(people.schema))).collect())


@pytest.mark.parametrize(
    "p, want",
    [
        (N.lt("age", 30), "ae"), (N.neq("age", 20), "bcde"), (N.not_(N.eq("age", 20)), "bcde"), (N.is_null("age"), "bc"), (N.is_not_null("age"), "ade"),
        (N.not_(N.lt("age", 30)), "bcd"), (N.eq("age", None), ""), (N.neq("age", None), "abcde"), (N.eq(N.field("age"), None), "bc"),
        (N.eq("age", "20"), ""), (N.neq("age", "20"), "abcde"), (N.gt("name", 5), ""), (N.in_list("age", []), ""), (N.not_in_list("age", [20, None]), "bcde"),
        (N.eq("tags", "y"), "ad"), (N.neq("tags", "y"), "bce"), (N.size("tags", 0), "c"), (N.not_(N.size("tags", 2)), "bce"), (N.contains("tags", "z"), "e"),
        (N.any_element("tags", N.starts_with("value", "x")), "a"), (N.eq("address.city", "NYC"), "a"), (N.gte("address.zip", 2), "ce"), (N.exists("tags.0"), ""),
        (N.starts_with("name", "é", ignore_case=True), ""), (N.includes_text("name", "%"), "e"), (N.starts_with("name", "ANN", ignore_case=True), "a"), (N.ends_with("name", ""), "abce"),
        (N.and_(), "abcde"), (N.or_(), ""), (N.gt(N.mul(N.field("score"), 2), 2), "ae"), (N.between("age", 0, 20), "ae"), (N.not_(N.between("age", 0, 20)), "bcd"),
    ],
)
def test_missing_values_and_types(people, p, want):
    assert found(people, p) == sorted(want)


def _tree(rng, depth):
    if depth and rng.random() < 0.6:
        kids = tuple(_tree(rng, depth - 1) for _ in range(rng.randint(0, 3)))
        return rng.choice([lambda: N.And(kids), lambda: N.Or(kids), lambda: N.Not(_tree(rng, depth - 1))])()
    path = rng.choice(["name", "age", "score", "address.city", "address.zip", "nothing"])
    v = rng.choice([20, 0, 1.5, "Ann", "NYC", True, -2.0])
    return rng.choice([
        lambda: N.Compare(path, rng.choice(N.OPS), v), lambda: N.In(path, (v, 40)), lambda: N.NotIn(path, (v, "Bo")), lambda: N.IsNull(path, rng.random() < 0.5),
        lambda: N.Exists(path, rng.random() < 0.5), lambda: N.TextMatch(path, rng.choice(["prefix", "suffix", "substring"]), rng.choice(["A", "n", ""])),
        lambda: N.Size("tags", rng.randint(0, 2)), lambda: N.Contains("tags", rng.choice(["x", "y"])), lambda: N.Between(path, v, v), lambda: N.Compare("tags", rng.choice(["=", "!="]), "y"),
    ])()


def test_random_trees_match_the_plain_rules(people):
    rng = random.Random(5)
    trees = [_tree(rng, 3) for _ in range(300)]
    scope = Scope(people.schema)
    got = people.select("uuid", *[F.coalesce(compiler.predicate(t, scope), F.lit(False)).alias(f"p{i}") for i, t in enumerate(trees)]).collect()
    for r in got:
        row = next(x for x in ROWS if x["uuid"] == r.uuid)
        for i, t in enumerate(trees):
            assert r[f"p{i}"] == holds(t, row), (t, row)


def test_filters_reach_the_scan(spark, tmp_path, people):
    people.write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    p = N.and_(N.eq("name", "Ann"), N.neq("age", 3), N.not_(N.gt("age", 30)), N.starts_with("name", "A"))
    plan = df.filter(compiler.predicate(p, Scope(df.schema)))._jdf.queryExecution().executedPlan().toString()
    for pushed in ("EqualNullSafe(name,Ann)", "Not(EqualNullSafe(age,3))", "IsNull(age)", "StringStartsWith(name,A)"):
        assert pushed in plan


@pytest.mark.parametrize(
    "doc, want",
    [
        ({}, "abcde"), ({"age": 20}, "a"), ({"age": {"$gte": 0, "$lt": 30}}, "ae"), ({"$nor": [{"age": 20}, {"name": "Bo"}]}, "cde"), ({"age": {"$not": {"$gt": 30}}}, "abce"),
        ({"tags": {"$all": ["y", "x"]}}, "a"), ({"tags": {"$elemMatch": {"$eq": "z"}}}, "e"), ({"name": {"$regex": "^a", "$options": "i"}}, "a"), ({"name": {"$regex": "^Bo$"}}, "b"),
        ({"$or": [{"age": 40}, {"address.city": "NYC"}]}, "ad"), ({"age": {"$exists": False}}, "bc"), ({"age": {"$nin": [20]}}, "bcde"),
    ],
)
def test_document_filters(people, doc, want):
    assert found(people, docfilter.parse(doc)) == sorted(want)


@pytest.mark.parametrize("doc", [{"a": {"$type": 1}}, {"a": {"$regex": "a.*b"}}, {"a": {"$regex": "^x$", "$options": "i"}}, {"$where": "1"}, {"a": {"$mod": [2, 0]}}])
def test_unsupported_filters_raise(doc):
    with pytest.raises(docfilter.Unsupported):
        docfilter.parse(doc)


def test_trees_survive_json_and_digests_ignore_order():
    p = N.and_(N.eq("a", 1), N.or_(N.gt(N.div(N.field("a"), 2), N.lit(1)), N.not_(N.in_list("b", ["x", None]))), N.any_element("t", N.size("value", 1)))
    assert N.from_json(p.to_json()) == p
    assert N.and_(N.eq("a", 1), N.eq("b", 2)).digest() == N.and_(N.eq("b", 2), N.eq("a", 1)).digest()


def test_values(spark):
    df = spark.createDataFrame([(9.0, 2.0, "x", 5, None, True), (5.0, 0.0, None, -7, 1.0, False)], "a double, b double, s string, n long, m double, t boolean")
    f, scope = N.field, Scope(df.schema)
    cases = {
        "div": (N.div(f("a"), f("b")), [4.5, 0.0]), "mod": (N.mod(f("a"), f("b")), [1.0, 0.0]), "sign": (N.mod(f("n"), 2), [1, -1]), "null0": (N.add(N.mul(f("a"), f("m")), 10), [10.0, 15.0]),
        "text": (N.concat(f("s"), f("a"), f("t")), ["x9true", "5false"]), "strnum": (N.add(N.lit("5"), f("n")), [10.0, -2.0]), "neg": (N.neg(f("m")), [0.0, -1.0]),
        "truthy": (N.all_of(f("s"), f("b")), [True, False]), "empty": (N.any_of(N.lit("")), [True, True]), "coal": (N.coalesce(f("m"), f("a")), [9.0, 1.0]),
        "cond": (N.cond(f("b"), "yes", "no"), ["yes", "no"]), "same": (N.cmp(f("m"), "=", None), [True, False]), "sw": (N.switch([(N.cmp(f("a"), ">", 8), 1)], 0), [1, 0]),
    }
    got = df.select(*[compiler.value(v, scope).col.alias(k) for k, (v, _) in cases.items()]).collect()
    for k, (_, want) in cases.items():
        assert [r[k] for r in got] == want, k


def test_dates_and_zones(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 23:30:00' AS ts")
    scope, ts = Scope(df.schema), N.field("ts")
    cols = [N.day_of_month(ts), N.day_of_month(ts, "Europe/Berlin"), N.day_of_week(ts), N.date_to_string(ts, "%Y'%m %d%%", "Europe/Berlin")]
    assert tuple(df.select(*[compiler.value(c, scope).col.alias(f"c{i}") for i, c in enumerate(cols)]).first()) == (1, 2, 2, "2024'01 02%")


def test_variants_tell_types_apart(spark):
    df = spark.sql("""SELECT uuid, parse_json(j) AS j FROM VALUES ('a', '{"x": 5}'), ('b', '{"x": "5"}'), ('c', '{}'), ('d', '{"x": {"y": 7.5}}') t(uuid, j)""")
    q = Catalog().add(Model("m", {"j": __import__("marrow.schema", fromlist=["x"]).Property("embedded", T.VariantType()), "n": integer(), "t": text(), "f": float_(), "a": array()}), df).query("m")
    ids = lambda p: sorted(r.uuid for r in q.filter(p).list())
    assert ids(N.eq("j.x", 5)) == ["a"] and ids(N.eq("j.x", "5")) == ["b"] and ids(N.gt("j.x.y", 7)) == ["d"]
