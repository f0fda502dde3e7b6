"""Registered queries over the test tables, each with the SQL that must give the same rows.

The tables have no nulls, so queries on missing values make some: ``v`` is an event's value, null below 10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.functions import nodes as N
from marrow.operators import documents, patch
from marrow.operators import query as Q
from marrow.operators.query import Catalog, Query
from marrow.schema import Model, Property, array, computed, date, float_, integer, scalar, text, to_many, to_one
from marrow.sources import io
from marrow.sources.store import change_rows
from marrow.streaming import live, sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int() -> Property:
    return scalar(T.IntegerType())


def _models(spark: SparkSession, sf_dir: str) -> Catalog:
    """The test tables as models: relations are the foreign keys."""
    t = lambda name: lambda: _table(spark, sf_dir, name)
    c = Catalog()
    c.add(Model("region", {"r_regionkey": _int(), "r_name": text()}, key="r_regionkey"), t("region"))
    c.add(Model("nation", {"n_nationkey": _int(), "n_name": text(), "n_regionkey": to_one("region")}, key="n_nationkey"), t("nation"))
    customer = {"c_custkey": integer(), "c_name": text(), "c_nationkey": to_one("nation"), "c_acctbal": float_(), "c_mktsegment": text()}
    c.add(Model("customer", customer | {"label": computed(lambda df: F.concat_ws("/", "c_mktsegment", "c_name"))}, key="c_custkey"), t("customer"))
    c.add(Model("part", {"p_partkey": integer(), "p_name": text(), "p_brand": text(), "p_type": text(), "p_size": _int(), "p_retailprice": float_()}, key="p_partkey"), t("part"))
    orders = {"o_orderkey": integer(), "o_custkey": to_one("customer"), "o_orderstatus": text(), "o_totalprice": float_(), "o_orderdate": date(), "o_orderpriority": text()}
    c.add(Model("orders", orders, key="o_orderkey"), t("orders"))
    lineitem = {n: float_() for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")} | {"l_orderkey": to_one("orders"), "l_partkey": to_one("part"), "l_suppkey": integer(), "l_linenumber": _int(), "l_returnflag": text(), "l_linestatus": text(), "l_shipdate": date(), "id": text()}
    c.add(Model("lineitem", lineitem, key="id"), lambda: t("lineitem")().withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")))
    events = {"event_id": integer(), "ts": date(), "user_id": integer(), "event_type": text(), "value": float_(), "props": text(), "v": float_()}
    c.add(Model("events", events, key="event_id"), lambda: t("events")().withColumn("v", F.when(F.col("value") >= 10, F.col("value"))))
    c.add(Model("documents", {"doc_id": integer(), "text": text(), "lang": text(), "source": text(), "n_chars": integer()}, key="doc_id"), t("documents"))
    words = {"p_partkey": integer(), "words": array(), "sizes": array(T.LongType()), "maker": Property("embedded", T.StructType()), "parts": Property("embedded", T.StructType())}
    shaped = lambda: t("part")().select("p_partkey", F.split("p_name", " ").alias("words"), F.array(F.col("p_size").cast("long"), F.lit(None).cast("long"), (F.col("p_size") * 2).cast("long")).alias("sizes"), F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("size")).alias("at")).alias("maker"), F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("word"), F.length(w).alias("n"))).alias("parts"))
    c.add(Model("shaped", words, key="p_partkey"), shaped)
    baskets = lambda: t("lineitem")().groupBy(F.col("l_orderkey").alias("b_key")).agg(F.array_sort(F.collect_set("l_partkey")).alias("items"))
    c.add(Model("baskets", {"b_key": integer(), "items": to_many("part")}, key="b_key"), baskets)
    return c


def _q(spark: SparkSession, sf_dir: str, name: str) -> Query:
    return _models(spark, sf_dir).query(name)


EV = "WITH e AS (SELECT *, CASE WHEN value >= 10 THEN value END AS v FROM events) "


# the flagship, and grouped aggregates
@registered("""SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, sum(l_quantity) AS sum_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def agg_group_many(spark, d):
    from datetime import datetime

    q = _q(spark, d, "lineitem").filter(N.lte("l_shipdate", datetime(1998, 9, 2)))
    out = q.group_by(["l_returnflag", "l_linestatus"], revenue=Q.sum_(N.mul(N.field("l_extendedprice"), N.sub(1, N.field("l_discount")))), sum_qty=Q.sum_("l_quantity"), n=Q.count())
    return out.withColumn("revenue", F.round("revenue", 2))


@registered("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def agg_global(spark, d):
    out = _q(spark, d, "orders").aggregate(n=Q.count(), total=Q.sum_("o_totalprice"), mean=Q.avg("o_totalprice"), lo=Q.min_("o_totalprice"), hi=Q.max_("o_totalprice"))
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@registered("SELECT 0::BIGINT AS n, 0.0::DOUBLE AS total, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS lo, 0::BIGINT AS users")
def agg_empty(spark, d):
    q = _q(spark, d, "events").filter(N.eq("event_type", "no such type"))
    return q.aggregate(n=Q.count(), total=Q.sum_("v"), mean=Q.avg("v"), lo=Q.min_("v"), users=Q.count_distinct("user_id"))


@registered(EV + "SELECT event_type, count(*) AS n, round(coalesce(sum(v), 0), 2) AS total, round(coalesce(avg(v), 0), 4) AS mean, coalesce(min(v), 0) AS lo FROM e GROUP BY 1")
def agg_group_field(spark, d):
    out = _q(spark, d, "events").group_by("event_type", n=Q.count(), total=Q.sum_("v"), mean=Q.avg("v"), lo=Q.min_("v"))
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@registered("SELECT year(o_orderdate)::BIGINT AS key, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def agg_group_expr(spark, d):
    return _q(spark, d, "orders").group_by(N.year(N.field("o_orderdate")), n=Q.count(), total=Q.sum_("o_totalprice")).withColumn("total", F.round("total", 2))


@registered("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_count_distinct(spark, d):
    return _q(spark, d, "events").group_by("event_type", users=Q.count_distinct("user_id"))


@registered("SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS closed FROM orders GROUP BY 1")
def agg_conditional_sum(spark, d):
    test = N.cmp(N.field("o_orderstatus"), "=", "F")
    return _q(spark, d, "orders").group_by("o_orderpriority", closed=Q.sum_(N.cond(test, N.field("o_totalprice"), 0.0))).withColumn("closed", F.round("closed", 2))


@registered(EV + "SELECT DISTINCT v FROM e")
def distinct_field(spark, d):
    return _q(spark, d, "events").distinct("v")


@registered(EV + "SELECT v > 50 AS big, count(*) AS n FROM (SELECT coalesce(v, 0) AS v FROM e) GROUP BY 1")
def agg_bool_key(spark, d):
    return _q(spark, d, "events").group_by({"big": N.cmp(N.coalesce(N.field("v"), 0.0), ">", 50.0)}, n=Q.count())


# predicates
@registered(EV + "SELECT event_id, v FROM e WHERE v > 20 AND v <= 90 AND event_type = 'click' AND user_id >= 10 AND user_id < 120")
def filter_compare_all(spark, d):
    p = N.and_(N.gt("v", 20), N.lte("v", 90), N.eq("event_type", "click"), N.gte("user_id", 10), N.lt("user_id", 120))
    return _q(spark, d, "events").filter(p).frame().select("event_id", "v")


@registered(EV + "SELECT event_id FROM e WHERE v IS DISTINCT FROM 12.31 AND NOT (coalesce(v < 50, false))")
def filter_neq_missing(spark, d):
    return _q(spark, d, "events").filter(N.and_(N.neq("v", 12.31), N.not_(N.lt("v", 50)))).ids()


@registered("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND (user_id NOT IN (1, 2, 3))")
def filter_in_nin(spark, d):
    return _q(spark, d, "events").filter(N.and_(N.in_list("event_type", ["click", "view", None]), N.not_in_list("user_id", [1, 2, 3]))).ids()


@registered(EV + "SELECT event_id FROM e WHERE v IS NULL OR v NOT IN (12.31, 50.0)")
def filter_nin_missing(spark, d):
    return _q(spark, d, "events").filter(N.not_in_list("v", [12.31, 50.0])).ids()


@registered(EV + "SELECT event_id FROM e WHERE v BETWEEN 20 AND 40")
def filter_between(spark, d):
    return _q(spark, d, "events").filter(N.between("v", 20, 40)).ids()


@registered(EV + "SELECT event_id FROM e WHERE NOT coalesce((v > 50 AND event_type = 'view') OR v < 20, false) ")
def filter_and_or_not(spark, d):
    p = N.not_(N.or_(N.and_(N.gt("v", 50), N.eq("event_type", "view")), N.lt("v", 20)))
    return _q(spark, d, "events").filter(p).ids()


@registered(EV + "SELECT event_id FROM e WHERE v IS NULL")
def filter_is_null(spark, d):
    return _q(spark, d, "events").filter(N.is_null("v")).ids()


@registered(EV + "SELECT event_id FROM e WHERE v IS NOT NULL AND user_id < 50")
def filter_exists(spark, d):
    return _q(spark, d, "events").filter(N.and_(N.exists("v"), N.is_not_null("v"), N.exists("nothing", False), N.lt("user_id", 50))).ids()


@registered("SELECT event_id FROM events WHERE false UNION ALL SELECT event_id FROM events")
def filter_strict_types(spark, d):
    never = N.or_(N.eq("event_type", 5), N.gt("event_type", 5), N.eq("user_id", "5"), N.in_list("user_id", []))
    always = N.and_(N.neq("event_type", 5), N.not_in_list("user_id", []), N.everything())
    q = _q(spark, d, "events")
    return q.filter(never).ids().union(q.filter(always).ids())


@registered("SELECT p_partkey FROM part WHERE starts_with(p_name, 'small')")
def filter_text_prefix(spark, d):
    return _q(spark, d, "part").filter(N.starts_with("p_name", "small")).ids()


@registered("SELECT p_partkey FROM part WHERE ends_with(p_name, 'ring')")
def filter_text_suffix(spark, d):
    return _q(spark, d, "part").filter(N.ends_with("p_name", "ring")).ids()


@registered("SELECT doc_id FROM documents WHERE contains(text, 'the the') AND NOT contains(text, '%')")
def filter_text_substring(spark, d):
    return _q(spark, d, "documents").filter(N.and_(N.includes_text("text", "the the"), N.not_(N.includes_text("text", "%")))).ids()


@registered("SELECT doc_id FROM documents WHERE starts_with(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'é') OR contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'mit license')")
def filter_text_ci_ascii(spark, d):
    return _q(spark, d, "documents").filter(N.or_(N.starts_with("text", "é", ignore_case=True), N.includes_text("text", "MIT LICENSE", ignore_case=True))).ids()


@registered("SELECT id FROM (SELECT l_orderkey || '-' || l_linenumber AS id, l_extendedprice * l_discount AS x, l_tax FROM lineitem) WHERE x > 3000 AND l_tax * 2 >= 0.1")
def filter_expr_arith(spark, d):
    p = N.and_(N.gt(N.mul(N.field("l_extendedprice"), N.field("l_discount")), 3000), N.gte(N.mul(N.field("l_tax"), 2), 0.1))
    return _q(spark, d, "lineitem").filter(p).ids()


# values
@registered(EV + "SELECT event_id, round(coalesce(v, 0) * 2 + user_id - 1, 4) AS x, -coalesce(v, 0) AS y FROM e")
def value_arith_null_zero(spark, d):
    x = N.sub(N.add(N.mul(N.field("v"), 2), N.field("user_id")), 1)
    return _q(spark, d, "events").select({"event_id": True, "x": x, "y": N.neg(N.field("v"))}).withColumn("x", F.round("x", 4))


@registered("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE round(value / (user_id % 3), 6) END AS q, CASE WHEN user_id % 3 = 0 THEN 0 ELSE event_id % (user_id % 3) END AS r FROM events")
def value_div_mod_guard(spark, d):
    k = N.mod(N.field("user_id"), 3)
    return _q(spark, d, "events").select({"event_id": True, "q": N.div(N.field("value"), k), "r": N.mod(N.field("event_id"), k)}).withColumn("q", F.round("q", 6))


@registered("SELECT c_custkey, c_name || ':' || c_mktsegment || ':' || c_custkey AS s FROM customer")
def value_concat(spark, d):
    return _q(spark, d, "customer").select({"c_custkey": True, "s": N.concat(N.field("c_name"), ":", N.field("c_mktsegment"), ":", N.field("c_custkey"), N.field("nothing"))})


@registered(EV + "SELECT event_id, coalesce(v, value, 0) AS x FROM e")
def value_coalesce(spark, d):
    return _q(spark, d, "events").select({"event_id": True, "x": N.coalesce(N.field("v"), N.field("value"), 0)})


@registered("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS side FROM customer")
def value_cond(spark, d):
    return _q(spark, d, "customer").select({"c_custkey": True, "side": N.cond(N.cmp(N.field("c_acctbal"), ">", 0), "credit", "debit")})


@registered("SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size FROM orders")
def value_switch(spark, d):
    at = lambda n: N.cmp(N.field("o_totalprice"), ">", n)
    return _q(spark, d, "orders").select({"o_orderkey": True, "size": N.switch([(at(400000), "large"), (at(100000), "middle")], "small")})


@registered(EV + "SELECT event_id, (coalesce(v, 0) <> 0 AND user_id <> 0) AS both, (coalesce(v, 0) <> 0 OR user_id <> 0) AS either, coalesce(v, 0) = 0 AS none FROM e")
def value_bool_ops(spark, d):
    v, u = N.field("v"), N.field("user_id")
    return _q(spark, d, "events").select({"event_id": True, "both": N.all_of(v, u), "either": N.any_of(v, u), "none": N.negate(v)})


_PARTS = ("year", "month", "dayOfMonth", "dayOfWeek", "hour", "minute", "second")


@registered("SELECT event_id, year(ts) AS y0, month(ts) AS y1, day(ts) AS y2, dayofweek(ts) + 1 AS y3, hour(ts) AS y4, minute(ts) AS y5, second(ts) AS y6 FROM events")
def date_parts_utc(spark, d):
    return _q(spark, d, "events").select({"event_id": True} | {f"y{i}": N.date_part(p, N.field("ts")) for i, p in enumerate(_PARTS)})


@registered("SELECT o_orderkey, year(t) AS y, month(t) AS m, day(t) AS dd, hour(t) AS h FROM (SELECT o_orderkey, (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM orders)")
def date_parts_tz(spark, d):
    x = N.field("o_orderdate")
    tz = "America/New_York"
    return _q(spark, d, "orders").select({"o_orderkey": True, "y": N.year(x, tz), "m": N.month(x, tz), "dd": N.day_of_month(x, tz), "h": N.hour(x, tz)})


@registered("SELECT event_id, strftime(ts, '%Y-%m-%d') || ' at ' || strftime(ts, '%H:%M:%S%%') AS s FROM events")
def date_to_string(spark, d):
    return _q(spark, d, "events").select({"event_id": True, "s": N.date_to_string(N.field("ts"), "%Y-%m-%d at %H:%M:%S%%")})


@registered("SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin', '%Y-%m-%d %H:%M') AS s FROM events")
def date_to_string_tz(spark, d):
    return _q(spark, d, "events").select({"event_id": True, "s": N.date_to_string(N.field("ts"), "%Y-%m-%d %H:%M", "Europe/Berlin")})


# arrays and embedded documents
@registered("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red')")
def array_contains(spark, d):
    return _q(spark, d, "shaped").filter(N.contains("words", "red")).ids()


@registered("SELECT p_partkey FROM part WHERE p_size > 40 OR p_size * 2 > 40")
def array_any(spark, d):
    return _q(spark, d, "shaped").filter(N.any_element("sizes", N.gt("value", 40))).ids()


@registered("SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 4 AND w <> 'widget')) > 0")
def array_any_struct(spark, d):
    return _q(spark, d, "shaped").filter(N.any_element("parts", N.and_(N.gt("n", 4), N.neq("word", "widget")))).ids()


@registered("SELECT p_partkey FROM part WHERE len(string_split(p_name, ' ')) = 2")
def array_size(spark, d):
    return _q(spark, d, "shaped").filter(N.size("words", 2)).ids()


@registered("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring') AND NOT list_contains(string_split(p_name, ' '), 'red')")
def array_eq_membership(spark, d):
    return _q(spark, d, "shaped").filter(N.and_(N.eq("words", "ring"), N.neq("words", "red"))).ids()


@registered("SELECT p_partkey, p_brand AS brand FROM part WHERE p_size > 20 AND p_brand <> 'Brand#2'")
def embedded_path_filter(spark, d):
    p = N.and_(N.gt("maker.at.size", 20), N.neq("maker.brand", "Brand#2"), N.exists("parts.word", False))
    return _q(spark, d, "shaped").filter(p).select({"p_partkey": True, "maker.brand": True})


@registered("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def variant_path_filter(spark, d):
    rows = _table(spark, d, "events").select("event_id", F.parse_json("props").alias("props"))
    m = Model("events", {"event_id": integer(), "props": Property("embedded", T.VariantType())}, key="event_id")
    q = Catalog().add(m, rows).query("events")
    return q.filter(N.gte("props.k", 50)).select({"event_id": True, "k": N.add(N.field("props.k"), 0)})


# windows
def _window(fn: str) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        q = _q(spark, d, "orders").sort("o_orderpriority").sort("o_orderdate", True)
        return q.windowed(["o_custkey"], n=fn).select("o_orderkey", "n")

    return run


for _name, _fn, _order in (("row_number", "rowNumber", "o_orderpriority, o_orderdate DESC, o_orderkey"), ("rank", "rank", "o_orderpriority, o_orderdate DESC"), ("dense_rank", "denseRank", "o_orderpriority, o_orderdate DESC")):
    QUERIES[f"window_{_name}"] = _window(_fn)
    ORACLE[f"window_{_name}"] = f"SELECT o_orderkey, {_name}() OVER (PARTITION BY o_custkey ORDER BY {_order}) AS n FROM orders"


@registered("SELECT c_custkey, 1::BIGINT AS n FROM customer")
def window_no_order(spark, d):
    return _q(spark, d, "customer").windowed(["c_mktsegment"], n="rank").select("c_custkey", "n")


@registered("SELECT n_nationkey, rank() OVER (ORDER BY n_regionkey) AS n FROM nation")
def window_no_partition(spark, d):
    return _q(spark, d, "nation").sort("n_regionkey").windowed([], n="rank").select("n_nationkey", "n")


@registered("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def topn_per_group(spark, d):
    return _q(spark, d, "orders").sort("o_totalprice", True).windowed(["o_custkey"], n="rowNumber").filter("n <= 2").select("o_custkey", "o_orderkey")


# order and pages
@registered(EV + "SELECT event_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v ASC NULLS FIRST, event_type DESC, event_id) AS place FROM e")
def sort_multi_nulls(spark, d):
    return _q(spark, d, "events").sort("v").sort("event_type", True).windowed(["user_id"], place="rowNumber").select("event_id", "v", "place")


@registered("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 20")
def slice_offset(spark, d):
    return _q(spark, d, "orders").sort("o_totalprice", True).slice(20, 50).ids()


@registered("SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 26 OFFSET 25")
def keyset_page_2(spark, d):
    q = _q(spark, d, "orders").sort("o_orderpriority")
    return q.page_frame(25, q.page(25).cursor).select("o_orderkey")


@registered("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    return _q(spark, d, "orders").sort("o_totalprice", True).slice(0, 10).frame().select("o_orderkey", "o_totalprice")


@registered("SELECT * FROM (VALUES (5, 'x'), (3, 'y'), (9, 'z')) t(n, tag) WHERE n IN (SELECT c_custkey FROM customer)")
def get_many_ordered(spark, d):
    m = Model("customer", {"c_custkey": integer()}, key="c_custkey")
    rows = Catalog().add(m, _table(spark, d, "customer").select("c_custkey")).query("customer").get_many([5, 3, 9, -1])
    return rows.select(F.col("c_custkey").cast("int").alias("n"), F.element_at(F.create_map(F.lit(5), F.lit("x"), F.lit(3), F.lit("y"), F.lit(9), F.lit("z")), F.col("c_custkey").cast("int")).alias("tag"))


# relations
@registered("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'")
def rel_filter_to_one(spark, d):
    return _q(spark, d, "orders").filter(N.and_(N.eq("o_custkey.c_mktsegment", "BUILDING"), N.eq("o_orderstatus", "O"))).ids()


@registered("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def rel_filter_two_hops(spark, d):
    return _q(spark, d, "customer").filter(N.eq("c_nationkey.n_regionkey.r_name", "EUROPE")).ids()


@registered("SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE coalesce(c_mktsegment = 'BUILDING', false) OR (o_totalprice > 300000 AND NOT coalesce(c_acctbal > 0, false))")
def rel_filter_or_not(spark, d):
    p = N.or_(N.eq("o_custkey.c_mktsegment", "BUILDING"), N.and_(N.gt("o_totalprice", 300000), N.not_(N.gt("o_custkey.c_acctbal", 0))))
    return _q(spark, d, "orders").filter(p).ids()


@registered("SELECT DISTINCT l_orderkey AS b_key FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7")
def rel_filter_to_many(spark, d):
    return _q(spark, d, "baskets").filter(N.eq("items.p_size", 7)).ids()


@registered("SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def rel_load_to_one(spark, d):
    df = _q(spark, d, "orders").load("o_custkey")
    return df.select("o_orderkey", "o_custkey.c_name", "o_custkey.c_acctbal")


@registered("SELECT l_orderkey AS b_key, string_agg(p_name, ',' ORDER BY p_partkey) AS names FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1")
def rel_load_to_many(spark, d):
    df = _q(spark, d, "baskets").select({"b_key": True, "items": {"p_name": True}})
    return df.select("b_key", F.array_join(F.transform("items", lambda x: x["p_name"]), ",").alias("names")).filter("names <> ''")


@registered("SELECT o_orderkey, c_name AS customer, n_name AS nation, o_totalprice * 2 AS twice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")
def select_nested(spark, d):
    q = _q(spark, d, "orders").filter(N.eq("o_orderstatus", "F"))
    df = q.select({"o_orderkey": True, "o_custkey": {"c_name": True, "c_nationkey": {"n_name": True}}, "twice": N.mul(N.field("o_totalprice"), 2)})
    return df.select("o_orderkey", F.col("o_custkey.c_name").alias("customer"), F.col("o_custkey.c_nationkey.n_name").alias("nation"), "twice")


@registered("SELECT c_custkey, c_mktsegment || '/' || c_name AS label FROM customer")
def computed_property(spark, d):
    return _q(spark, d, "customer").select({"c_custkey": True, "label": True})


# documents
@registered(EV + "SELECT event_id FROM e WHERE (event_type = 'click' OR v > 60) AND user_id NOT IN (4, 5) AND NOT coalesce(v < 15, false)")
def doc_filter_mixed(spark, d):
    doc = {"$or": [{"event_type": "click"}, {"v": {"$gt": 60}}], "user_id": {"$nin": [4, 5]}, "v": {"$not": {"$lt": 15}}}
    return documents.find(_models(spark, d), "events", doc).ids()


@registered(EV + "SELECT event_id FROM e WHERE NOT (event_type = 'view' OR coalesce(v <= 30, false)) AND contains(props, '7') AND v IS NOT NULL")
def doc_filter_nor_regex(spark, d):
    doc = {"$nor": [{"event_type": {"$eq": "view"}}, {"v": {"$lte": 30}}], "props": {"$regex": "7"}, "v": {"$exists": True}}
    return documents.find(_models(spark, d), "events", doc).ids()


@registered("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'ring') AND len(string_split(p_name, ' ')) = 2")
def doc_filter_arrays(spark, d):
    return documents.find(_models(spark, d), "shaped", {"words": {"$all": ["red", "ring"], "$size": 2, "$elemMatch": {"$in": ["ring"]}}}).ids()


@registered(EV + "SELECT event_type AS _id, count(*) AS n, round(coalesce(sum(v), 0), 2) AS total, coalesce(max(v), 0) AS hi FROM e WHERE user_id < 100 GROUP BY 1")
def doc_pipeline_group(spark, d):
    stages = [{"$match": {"user_id": {"$lt": 100}}}, {"$limit": 3}, {"$group": {"_id": "$event_type", "n": {"$sum": 1}, "total": {"$sum": "$v"}, "hi": {"$max": "$v"}}}]
    return documents.pipeline(_models(spark, d), "events", stages).withColumn("total", F.round("total", 2))


@registered("SELECT event_type AS _id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, _id LIMIT 2 OFFSET 1")
def doc_pipeline_post_sort_limit(spark, d):
    stages = [{"$group": {"_id": "$event_type", "n": {"$count": {}}}}, {"$sort": {"n": -1, "_id": 1}}, {"$skip": 1}, {"$limit": 2}]
    return documents.pipeline(_models(spark, d), "events", stages)


@registered("SELECT count(*) AS n FROM events WHERE event_type = 'view'")
def doc_pipeline_count(spark, d):
    return documents.pipeline(_models(spark, d), "events", [{"$match": {"event_type": "view"}}, {"$skip": 5}, {"$count": "n"}])


@registered("SELECT event_id FROM events WHERE event_type = 'view' ORDER BY value DESC, event_id LIMIT 7 OFFSET 3")
def doc_find_paged(spark, d):
    return documents.find(_models(spark, d), "events", {"event_type": "view"}, sort={"value": -1}, skip=3, limit=7).ids()


# policies, soft deletes, updates: the rows afterwards
@registered("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def policy_read(spark, d):
    q = _models(spark, d).query("customer", policy=lambda m: N.eq("c_mktsegment", "BUILDING") if m.name == "customer" else None)
    return q.filter(N.gt("c_acctbal", 0)).ids()


@registered("SELECT c_custkey FROM customer WHERE c_acctbal >= 0")
def soft_delete_live(spark, d):
    rows = _table(spark, d, "customer").withColumn("deletedAt", F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("timestamp")))
    m = Model("customer", {"c_custkey": integer(), "c_acctbal": float_()}, key="c_custkey", soft_delete="deletedAt")
    return Catalog().add(m, rows).query("customer").ids()


@registered("SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN round(c_acctbal + 10, 2) ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_nationkey * 2 ELSE c_nationkey END AS c_nationkey FROM customer")
def patch_inc_mul(spark, d):
    c = _models(spark, d)
    out = patch.patched(c.frame("customer"), c.models["customer"], N.eq("c_mktsegment", "MACHINERY"), {"c_acctbal": patch.inc(10), "c_nationkey": patch.mul(2)})
    return out.select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", F.round("c_acctbal", 2)).otherwise(F.col("c_acctbal")).alias("c_acctbal"), "c_nationkey")


@registered("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || '!' ELSE p_name END AS p_name, CASE WHEN p_size > 25 THEN p_name ELSE p_brand END AS p_brand, CASE WHEN p_size > 25 THEN NULL ELSE p_type END AS p_type FROM part")
def patch_set_expr(spark, d):
    c = _models(spark, d)
    spec = {"p_name": patch.set_(N.concat(N.field("p_brand"), "!")), "p_brand": patch.set_(N.field("p_name")), "p_type": patch.unset()}
    return patch.patched(c.frame("part"), c.models["part"], N.gt("p_size", 25), spec).select("p_partkey", "p_name", "p_brand", "p_type")


@registered("SELECT p_partkey, array_to_string(list_concat(w, ['new', 'new']), ' ') AS pushed, array_to_string(CASE WHEN list_contains(w, 'red') THEN w ELSE list_append(w, 'red') END, ' ') AS added, array_to_string(list_filter(w, lambda x: x <> 'ring'), ' ') AS pulled FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def patch_array_ops(spark, d):
    c = _models(spark, d)
    m = c.models["shaped"]
    rows = c.frame("shaped").select("p_partkey", F.col("words").alias("pushed"), F.col("words").alias("added"), F.col("words").alias("pulled"))
    out = patch.patched(rows, m, N.everything(), {"pushed": patch.push("new", "new"), "added": patch.add_to_set("red", "red"), "pulled": patch.pull("ring")})
    return out.select("p_partkey", *[F.array_join(x, " ").alias(x) for x in ("pushed", "added", "pulled")])


@registered("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000, 'NEW' FROM customer WHERE c_custkey % 100 = 0")
def upsert_batch(spark, d):
    base = _table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = base.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(2).alias("at"))
    old = base.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("OLD").alias("c_mktsegment"), F.lit(1).alias("at"))
    more = base.filter("c_custkey % 100 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(1).alias("at"))
    return patch.merged(base, new.union(old).union(more), "c_custkey", "at")


@registered("SELECT 'p_name' AS columns, count(*) AS groups, sum(n)::BIGINT AS n FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1)")
def unique_violations(spark, d):
    m = Model("part", {"p_partkey": integer(unique=True), "p_name": text(unique=True)}, key="p_partkey")
    return patch.violations(_table(spark, d, "part"), m).groupBy("columns").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))


@registered("SELECT c_custkey, CASE WHEN c_custkey % 14 = 0 THEN 'c_acctbal,c_name' ELSE 'c_name' END AS fields FROM customer WHERE c_custkey % 7 = 0")
def dirty_diff(spark, d):
    base = _table(spark, d, "customer")
    seventh = F.col("c_custkey") % 7 == 0
    after = base.withColumn("c_name", F.when(seventh, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name"))).withColumn("c_acctbal", F.when(F.col("c_custkey") % 14 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return patch.dirty(base, after, "c_custkey").select("c_custkey", F.array_join(F.array_sort("fields"), ",").alias("fields"))


@registered("SELECT c_custkey, upper(c_name) AS c_name FROM customer WHERE c_acctbal > 5000")
def copy_transform(spark, d):
    return io.copied(_table(spark, d, "customer"), N.gt("c_acctbal", 5000), lambda df: df.select("c_custkey", F.upper("c_name").alias("c_name")))


# feeds and replication: events as changes of their users
def _changes(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.format_string("%015d:%06d:n", (F.col("event_id") * 7919 % 10007), F.lit(0))
    kind = F.when(F.col("event_type") == "error", "removed").otherwise("saved")
    record = F.to_json(F.struct(F.col("event_type").alias("a"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("b")))
    return _table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"), F.lit("u").alias("model"), F.col("user_id").cast("string").alias("key"), kind.alias("kind"), record.alias("record"), stamp.alias("version"), F.lit(None).cast("string").alias("fields"))


@registered("""SELECT key, max(event_type) AS event_type, kind FROM (
  SELECT user_id::VARCHAR AS key, event_type, CASE WHEN event_type = 'error' THEN 'removed' ELSE 'saved' END AS kind FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 10007 DESC, event_id) = 1) GROUP BY ALL""")
def sync_lww_fold(spark, d):
    return sync.lww(_changes(spark, d)).select("key", F.get_json_object("record", "$.a").alias("event_type"), "kind")


@registered("""WITH s AS (SELECT *, event_id * 7919 % 10007 AS ver FROM events WHERE event_type <> 'error'),
a AS (SELECT user_id, event_type AS a FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ver DESC, event_id) = 1),
b AS (SELECT user_id, props AS b FROM s WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ver DESC, event_id) = 1),
alive AS (SELECT user_id FROM events GROUP BY 1
  HAVING coalesce(max(CASE WHEN event_type <> 'error' THEN event_id * 7919 % 10007 END) > coalesce(max(CASE WHEN event_type = 'error' THEN event_id * 7919 % 10007 END), -1), false))
SELECT a.user_id::VARCHAR AS key, a, b FROM a JOIN alive USING (user_id) LEFT JOIN b USING (user_id)""")
def sync_field_merge(spark, d):
    return sync.merge_fields(_changes(spark, d)).select("key", F.try_element_at("record", F.lit("a")).alias("a"), F.try_element_at("record", F.lit("b")).alias("b"))


@registered("SELECT event_id + 1 AS seq, user_id::VARCHAR AS key FROM events WHERE event_id >= 500 ORDER BY 1")
def sync_pull_after_cursor(spark, d):
    return sync.pull(_changes(spark, d), 500).select("seq", "key")


@registered("SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 20 = 0 THEN 'removed' ELSE 'saved' END AS kind FROM customer WHERE c_custkey % 10 = 0")
def change_log_before_after(spark, d):
    base = _table(spark, d, "customer").select("c_custkey", "c_name")
    after = base.filter("c_custkey % 20 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, "renamed").otherwise(F.col("c_name")))
    m = Model("customer", {"c_custkey": integer(), "c_name": text()}, key="c_custkey")
    return change_rows(m, base, after).select(F.col("key").cast("string").alias("key"), "kind")


@registered("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_time_tumbling(spark, d):
    out = live.tumbling(_table(spark, d, "events"), "ts", "1 day", "event_type", n=F.count(F.lit(1)))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@registered("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def event_time_sessions(spark, d):
    out = live.sessions(_table(spark, d, "events"), "ts", "6 hours", "user_id", n=F.count(F.lit(1)))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@registered("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 3")
def raw_sql(spark, d):
    for name in ("customer", "nation"):
        _table(spark, d, name).createOrReplaceTempView(f"marrow_{name}")
    return spark.sql("SELECT n_name, count(*) AS n FROM marrow_customer JOIN marrow_nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > :least", args={"least": 3})
