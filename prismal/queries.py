"""Queries over the star domain in several designs, and the same in plain SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import faults, star
from .functions import workload
from .model import NESTED, Design, ModelError
from .operators import cost, report, validate
from .operators.catalog import Catalog
from .operators.insert import insert, insertion_points
from .operators.migrate import migrate
from .operators.query import costs, query
from .plans import checks
from .sources import ddl, logs, store

Query = Callable[[SparkSession, str], DataFrame]

# name: (project, pattern, filter, designs, SQL)
SPECS: dict[str, tuple[list[str], list[str], str | None, list[str], str]] = {
    "customer_scan": (["c_custkey", "c_name"], ["Customer"], "c_mktsegment = 'BUILDING'", ["normalized", "nested_customer", "two_sets"], "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "star_part": (["*"], ["Part"], None, ["normalized"], "SELECT * FROM part"),
    "class_star": (["c_custkey", "Order_*"], ["Customer", "OrderCust", "Order"], None, ["normalized", "nested_customer"], "SELECT c_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey"),
    "ends_only": (["o_custkey", "cust_order"], ["OrderCust"], None, ["normalized", "vertical"], "SELECT o_custkey, o_orderkey AS cust_order FROM orders"),
    "order_lines": (["o_orderkey", "l_partkey"], ["Order", "LineOrder", "LineItem", "LinePart"], "l_quantity > 49 AND o_totalprice > 100000", ["normalized", "denorm_line", "nested_orders"], "SELECT o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49 AND o_totalprice > 100000"),
    "cust_order_line": (["c_custkey", "o_orderkey", "l_partkey"], ["Customer", "OrderCust", "Order", "LineOrder", "LineItem", "LinePart"], None, ["normalized", "denorm_line", "nested_orders"], "SELECT c_custkey, o_orderkey, l_partkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"),
    "geo_chain": (["c_custkey", "n_name", "r_name"], ["Customer", "CustNation", "Nation", "NationRegion", "Region"], None, ["normalized", "nested_customer"], "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "loose_loose": (["l_orderkey", "l_partkey"], ["LineOrder", "LinePart"], None, ["normalized"], "SELECT l_orderkey, l_partkey FROM lineitem"),
    "skip_class": (["c_custkey", "l_partkey"], ["Customer", "OrderCust", "LineOrder", "LinePart"], None, ["normalized"], "SELECT o_custkey AS c_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey"),
    "or_filter": (["p_partkey"], ["Part"], "p_size = 10 OR p_retailprice < 950", ["normalized"], "SELECT p_partkey FROM part WHERE p_size = 10 OR p_retailprice < 950"),
    "between": (["o_orderkey"], ["Order"], "o_totalprice BETWEEN 1000 AND 20000", ["normalized", "per_status"], "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000"),
    "paren_in": (["o_orderkey"], ["Order"], "(o_orderstatus IN ('F', 'P')) AND o_totalprice > 1000", ["normalized", "vertical"], "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 1000"),
    "subclass": (["o_orderkey"], ["FinishedOrder"], None, ["normalized", "per_status"], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "super_union": (["o_orderkey", "o_totalprice"], ["Order"], None, ["per_status"], "SELECT o_orderkey, o_totalprice FROM orders"),
    "super_union_join": (["c_name", "o_orderkey"], ["Order", "OrderCust", "Customer"], None, ["per_status"], "SELECT c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey"),
    "overlap_union": (["p_partkey", "p_size"], ["Part"], None, ["per_size"], "SELECT p_partkey, p_size FROM part"),
    "vertical": (["o_orderkey", "o_orderpriority", "o_totalprice"], ["Order"], None, ["vertical"], "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"),
    "unnest_filter": (["o_orderkey", "l_quantity"], ["Order", "LineOrder", "LineItem"], "l_quantity = 1", ["nested_orders"], "SELECT o_orderkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity = 1"),
    "two_sets": (["c_custkey", "o_orderkey", "event_id"], ["Customer", "OrderCust", "Order", "EventCust", "Event"], "c_mktsegment = 'BUILDING'", ["normalized", "two_sets"], "SELECT c_custkey, o_orderkey, event_id FROM customer JOIN orders ON o_custkey = c_custkey JOIN events ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "id_list": (["n_nationkey", "c_custkey"], ["Nation", "CustNation"], None, ["normalized", "id_list"], "SELECT c_nationkey AS n_nationkey, c_custkey FROM customer"),
    "id_list_join": (["n_name", "c_name"], ["Nation", "CustNation", "Customer"], None, ["id_list"], "SELECT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "event_types": (["event_id", "value"], ["PurchaseEvent"], None, ["normalized"], "SELECT event_id, value FROM events WHERE event_type = 'purchase'"),
    "line_flags": (["l_orderkey", "l_linenumber"], ["ReturnedLine", "LineOrder"], "l_discount > 0.05", ["normalized"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05"),
    "loose_loose_join": (["o_custkey", "l_orderkey"], ["OrderCust", "LineOrder"], None, ["link_tables"], "SELECT o_custkey, l_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey"),
    "two_plugs": (["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["Order", "OrderCust"], None, ["two_keys"], "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"),
    "two_unions": (["o_orderkey", "o_orderstatus", "p_partkey", "p_size"], ["Order", "LineOrder", "LineItem", "LinePart", "Part"], None, ["per_status_size"], "SELECT DISTINCT o_orderkey, o_orderstatus, p_partkey, p_size FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"),
    "union_of_unions": (["o_orderkey", "o_orderstatus", "o_orderpriority"], ["Order"], "o_totalprice > 50000", ["per_urgency"], "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 50000"),
    "urgent": (["o_orderkey"], ["UrgentOrder"], None, ["normalized", "per_urgency"], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "doc_labels": (["doc_id", "lang", "quality"], ["Document", "LabelOf", "Label"], None, ["normalized"], "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)"),
    "supplier_chain": (["s_name", "n_name", "l_orderkey"], ["Supplier", "SuppNation", "Nation", "LineSupp", "LineOrder"], "l_orderkey > 0 AND n_name IS NOT NULL", ["normalized"], "SELECT s_name, n_name, l_orderkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey WHERE l_orderkey > 0"),
}


def _spec(name: str, design: str) -> Query:
    project, pattern, text, _, _ = SPECS[name]
    return lambda spark, sf_dir: query(star.catalog(spark, sf_dir, design), {"project": project, "pattern": pattern, "filter": text})


def denorm_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers read from rows of lines: each once, and only those with lines."""
    return query(star.catalog(spark, sf_dir, "denorm_line"), {"project": ["c_custkey", "c_name"], "pattern": ["Customer"]})


def param(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(star.base(spark, sf_dir), {"project": ["o_orderkey"], "pattern": ["Order"], "filter": "o_totalprice > $1 AND o_orderstatus = $2"}, values=[150000, "O"])


def by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(star.catalog(spark, sf_dir, "vertical"), {"project": ["o_orderkey", "o_custkey"], "pattern": ["Order", "OrderCust"]}, choose="cost")


def array_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables joined by keys that both keep in sets."""
    d = Design(star.domain(), "array_pair", NESTED)
    d.add_struct("line_of_part", ["LineItem"], ["l_id", "l_quantity"])
    d.add_set("part_lines", "line_of_part")
    d.add_struct("part_type", ["Part"], ["p_partkey", "p_name", "LinePart", "part_lines"])
    d.add_set("part_docs", "part_type")
    d.add_struct("line_of_supp", ["LineItem"], ["l_id", "l_discount"])
    d.add_set("supp_lines", "line_of_supp")
    d.add_struct("supp_type", ["Supplier"], ["s_suppkey", "s_name", "LineSupp", "supp_lines"])
    d.add_set("supp_docs", "supp_type")
    star._rest(d, "Part", "Supplier", "LineItem")
    made = migrate(star.base(spark, sf_dir), d)
    return query(made, {"project": ["p_partkey", "s_suppkey", "l_quantity", "l_discount"], "pattern": ["Part", "LinePart", "LineItem", "LineSupp", "Supplier"]})


def nest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.catalog(spark, sf_dir, "nested_orders").table("order_docs").select("o_orderkey", F.size("items").cast("long").alias("n_items"))


def pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair that looks like a key of the lines and isn't."""
    return validate.key_violations(star.base(spark, sf_dir), "lineitem", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "n_rows")


def pk_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.key_violations(star.base(spark, sf_dir), "orders")


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.all_reference_violations(star.base(spark, sf_dir))


def _lost(catalog: Catalog) -> Catalog:
    """The catalog without some of its customers, nations and parts."""
    for table, keep in LOST.items():
        catalog.tables[table] = catalog.table(table).where(keep)
    return catalog


def fk_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.all_reference_violations(_lost(star.base(spark, sf_dir)))


def fk_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References out of the sets of a nested table."""
    made = star.catalog(spark, sf_dir, "nested_orders")
    made.table("order_docs")
    return validate.all_reference_violations(_lost(made)).where("table = 'order_docs'")


def nested_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a nested table of which some rows stand twice."""
    made = star.catalog(spark, sf_dir, "nested_orders")
    docs = made.table("order_docs")
    made.tables["order_docs"] = docs.unionByName(docs.where("o_orderkey % 100 = 0"))
    return validate.key_violations(made, "order_docs")


def insert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of each design that can take an insert of an order of a customer."""
    data = {"o_orderkey", "o_custkey"}
    found = [(name, m.name) for name in ("normalized", "vertical", "two_keys", "link_tables", "denorm_line", "nested_orders") for m, _ in insertion_points(star.design(name), ("Order", "OrderCust"), data)[0]]
    return spark.createDataFrame(found, "design string, point string")


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each constraint tells of the model that breaks it; a sound model breaks none."""
    sound = not [v for v in checks.check(faults.design()) if v.severity == checks.ERROR]
    return spark.createDataFrame([(c, c in faults.errors(c)) for c in (*faults.DOMAINS, *faults.DESIGNS)] + [("none", sound)], "code string, told boolean")


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each faulty query is refused."""

    def is_refused(spec: dict) -> bool:
        try:
            query(star.base(spark, sf_dir), spec)
        except ModelError:
            return True
        return False

    return spark.createDataFrame([(why, is_refused(spec)) for why, spec in faults.QUERIES.items()], "why string, refused boolean")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; it goes when the driver's JVM ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
        top = tempfile.mkdtemp(prefix="prismal-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return path.toString()


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders saved in one design, superseded by another, loaded and asked."""
    where, plain = _scratch(spark, "stored"), faults.design()
    source = Catalog(spark, plain, {t: star.base(spark, sf_dir).table(t) for t in plain.tables()})
    source = store.save(source, where)
    nested = store.save(migrate(source, faults.design("nested_customer", NESTED)), f"{where}-nested")
    store.save(migrate(nested, faults.design("vertical")), where, supersede=True)
    return query(store.load(spark, where), {"project": ["c_name", "o_orderkey", "o_orderpriority"], "pattern": ["Customer", "OrderCust", "Order"]})


def ddl_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of a data definition as a class, its rows under the class's names, asked."""
    d = ddl.scaffold("CREATE TABLE shop.part (p_partkey bigint NOT NULL, p_name varchar(55), p_size integer, PRIMARY KEY (p_partkey)); -- parts", name="shop")
    design = Design(d, "flat")
    design.add_struct("part_type", ["part"], [a.name for a in d.classes["part"].attributes])
    design.add_set("parts", "part_type")
    rows = ddl.renamed(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size"), "part")
    return query(Catalog(spark, design, {"parts": rows}), {"project": ["*"], "pattern": ["part"], "filter": "part_p_size > 40"})


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of a workload's queries, run one by one."""
    names = ("customer_scan", "or_filter", "between", "subclass")
    lines = report.run(star.base(spark, sf_dir), [{"project": SPECS[n][0], "pattern": SPECS[n][1], "filter": SPECS[n][2]} for n in names], with_counts=True)
    return spark.createDataFrame([(n, x.count) for n, x in zip(names, lines, strict=True)], "query string, n long")


def insert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = insert(star.base(spark, sf_dir), {"data": {"r_regionkey": "99", "r_name": "'ATLANTIS'"}, "pattern": ["Region"]})
    return query(made, {"project": ["r_regionkey", "r_name"], "pattern": ["Region"]})


def _roundtrip(name: str) -> Query:
    """Normalised to another design and back: the orders' and lines' columns again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        back = migrate(star.catalog(spark, sf_dir, name), star.design("normalized"))
        if name in ("nested_orders", "denorm_line"):
            return back.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
        return back.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")

    return run


_LINES = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem"
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
ROUNDTRIPS = {"vertical": _ORDERS, "per_status": _ORDERS, "nested_customer": _ORDERS, "nested_orders": _LINES, "denorm_line": _LINES}

#: The statement that each kind of event stands for in a log; {} is the user.
STATEMENTS = {
    "click": "SELECT TOP 10 e.event_id, e.value FROM events AS e WHERE e.user_id = {}",
    "view": "select event_id, ts from events where value > 5 -- {}",
    "purchase": "SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.value BETWEEN 1 AND {} ORDER BY e.value",
    "signup": "SELECT count(*) FROM mydb.signups_{}",
    "error": "EXEC spLog {}",
}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a query log: when, whether it failed, how long it took, how many rows it gave, and what was asked."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    asked = F.coalesce(*[F.when(F.col("event_type") == k, F.concat(F.lit(a), F.col("user_id"), F.lit(b))) for k, s in STATEMENTS.items() for a, _, b in (s.partition("{}"),)])
    return events.select(F.col("ts").alias("the_time"), (F.col("user_id") % 7 == 0).cast("int").alias("error"), F.col("value").alias("elapsed"), (F.col("event_id") % 3).alias("rows"), asked.alias("statement"))


def log_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.count(_log(spark, sf_dir), 2024, 1, 9)


def log_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.statements(_log(spark, sf_dir), 2024, 1)


def _flat(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, ",") for n in names})


def w_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(workload.parsed(_log(spark, sf_dir))[0], "pattern", "project", "filters", "all_attributes")


def w_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.parsed(_log(spark, sf_dir))[1]


def w_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(workload.grouped(workload.parsed(_log(spark, sf_dir))[0], threshold=0.1, jaccard=0.6), "pattern", "project").drop("per_second", "group_id")


def w_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups told apart by TOP and ORDER BY, as numbered by falling frequency."""
    made = workload.grouped(workload.parsed(_log(spark, sf_dir))[0], threshold=0.1, jaccard=0.3, modifiers=("top", "orderby"))
    return _flat(made, "pattern", "project").select("pattern", "project", "filter", "n", F.get_json_object("modifiers", "$.top_value").alias("top_value"), F.get_json_object("modifiers", "$.has_order_by").alias("ordered"))


def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated cost of each rewriting of a weighted workload over the vertical design, and their weighted mean."""
    made = star.catalog(spark, sf_dir, "vertical")
    rows, best = [], []
    for name, weight in (("paren_in", 0.6), ("vertical", 0.4)):
        found = costs(made, {"project": SPECS[name][0], "pattern": SPECS[name][1], "filter": SPECS[name][2]})
        rows += [(name, ",".join(t), weight, float(c)) for t, c in found]
        best.append((min(c for _, c in found), weight))
    rows.append(("mean", "", 1.0, cost.weighted_mean(best)))
    return spark.createDataFrame(rows, "query string, tables string, weight double, cost double")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"q_{n}" + (f"__{d}" if d != "normalized" else ""): _spec(n, d) for n, s in SPECS.items() for d in s[3]}
    out |= {f"q_{f.__name__}": f for f in (denorm_dedupe, param, by_cost, array_array, nest_counts, pk_violations, pk_ok, fk_violations, fk_lost, fk_nested, nested_key, insert_points, constraints, refused, stored, ddl_scaffold, report_counts, log_count, log_fetch, cost_table)}
    out["q_insert"] = insert_query
    out |= {f"q_roundtrip_{n}": _roundtrip(n) for n in ROUNDTRIPS}
    return out | {f.__name__: f for f in (w_parse, w_rejects, w_group, w_modifiers)}


def _values(columns: str, rows: list[tuple]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(str(r).replace("True", "TRUE") for r in rows) + f") AS t({columns})"


#: What stays of some tables, so that references to the rest are lost.
LOST = {"customer": "c_custkey % 10 <> 0", "nation": "n_nationkey <> 3", "part": "p_partkey % 50 <> 0"}


def _fk_sql(lost: dict[str, str], nested: dict[str, str] | None = None) -> str:
    """Distinct values of each reference of the base tables that the referenced table, or what stays of it, lacks."""
    out, nested = [], nested or {}
    for end, cls, _, other, _ in star.ASSOCIATIONS.values():
        table, parent, key = star.TABLES[other], star.TABLES[cls], star.CLASSES[cls].split(":")[0]
        column = f"items.{end}" if nested and table == "lineitem" else end
        source = "doc_id" if end == "labelled" else end
        out.append(
            f"SELECT DISTINCT '{nested.get(table, table)}' AS \"table\", '{column}' AS \"column\", CAST({source} AS VARCHAR) AS value FROM {table} "
            f"WHERE {lost.get(table, 'TRUE')} AND {source} NOT IN (SELECT {key} FROM {parent} WHERE {lost.get(parent, 'TRUE')})"
        )
    return " UNION ALL ".join(out)


_LOG_SQL = (
    "SELECT ts, event_type, user_id % 7 <> 0 AND value > 0 AND event_id % 3 > 0 AS good, CASE event_type "
    + " ".join("WHEN '{}' THEN '{}' || user_id || '{}'".format(k, *s.split("{}")) for k, s in STATEMENTS.items())
    + " END AS statement FROM events"
)
_PARSED_SQL = """SELECT * FROM (VALUES
 ('click', 'events', 'events_event_id,events_value', 'events_user_id =', 'events_event_id,events_user_id,events_value', FALSE, FALSE, FALSE, 10),
 ('view', 'events', 'events_event_id,events_ts', 'events_value >', 'events_event_id,events_ts,events_value', FALSE, FALSE, FALSE, NULL),
 ('purchase', 'customer,events', 'customer_c_name,events_event_id', 'events_value between', 'customer_c_name,events_event_id,events_value', FALSE, FALSE, TRUE, NULL)
) AS t(event_type, pattern, project, filters, all_attributes, has_distinct, has_group_by, has_order_by, top_value)"""
_FILTERS_SQL = "SELECT * FROM (VALUES ('click', 'events_user_id = $1'), ('view', 'events_value > $1'), ('purchase', 'events_value BETWEEN $1 AND $2')) AS t(event_type, filter)"


def oracle_sql() -> dict[str, str]:
    out = {f"q_{n}" + (f"__{d}" if d != "normalized" else ""): s[4] for n, s in SPECS.items() for d in s[3]}
    out |= {f"q_roundtrip_{n}": sql for n, sql in ROUNDTRIPS.items()}
    return out | {
        "q_denorm_dedupe": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey)",
        "q_param": "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'",
        "q_by_cost": "SELECT o_orderkey, o_custkey FROM orders",
        "q_array_array": "SELECT l_partkey AS p_partkey, l_suppkey AS s_suppkey, l_quantity, l_discount FROM lineitem",
        "q_nest_counts": "SELECT o_orderkey, count(l_orderkey) AS n_items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
        "q_pk_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
        "q_pk_ok": "SELECT o_orderkey, count(*) AS n_rows FROM orders GROUP BY ALL HAVING count(*) > 1 OR o_orderkey IS NULL",
        "q_fk_violations": _fk_sql({}),
        "q_fk_lost": _fk_sql(LOST),
        "q_fk_nested": f"SELECT * FROM ({_fk_sql(LOST, {'orders': 'order_docs', 'lineitem': 'order_docs'})}) WHERE \"table\" = 'order_docs' AND \"column\" <> 'items.l_orderkey'",
        "q_nested_key": "SELECT o_orderkey, 2 AS n_rows FROM orders WHERE o_orderkey % 100 = 0",
        "q_insert_points": _values("design, point", [("normalized", "orders"), ("vertical", "orders_a"), ("two_keys", "orders_a"), ("two_keys", "orders_b"), ("nested_orders", "order_docs")]),
        "q_constraints": _values("code, told", [(c, True) for c in (*faults.DOMAINS, *faults.DESIGNS, "none")]),
        "q_refused": _values("why, refused", [(why, True) for why in faults.QUERIES]),
        "q_stored": "SELECT c_name, o_orderkey, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey",
        "q_ddl_scaffold": "SELECT p_partkey AS part_p_partkey, p_name AS part_p_name, p_size AS part_p_size FROM part WHERE p_size > 40",
        "q_report_counts": " UNION ALL ".join(f"SELECT '{n}' AS query, count(*) AS n FROM ({SPECS[n][4]})" for n in ("customer_scan", "or_filter", "between", "subclass")),
        "q_log_count": f"SELECT count(*) AS total_logs FROM ({_LOG_SQL}) WHERE good AND ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-10'",
        "q_log_fetch": f"SELECT statement FROM ({_LOG_SQL}) WHERE good AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'",
        "w_parse": f"SELECT p.* EXCLUDE event_type, statement FROM ({_LOG_SQL}) JOIN ({_PARSED_SQL}) AS p USING (event_type)",
        "w_rejects": f"SELECT statement, CASE event_type WHEN 'signup' THEN 'private or metadata' ELSE 'no select' END AS reason FROM ({_LOG_SQL}) WHERE event_type IN ('signup', 'error')",
        "w_group": f"""SELECT pattern, '{{}}' AS modifiers, all_attributes AS project, g.filter, count(*) AS n, count(*) / any_value(total) AS frequency, any_value(total) AS total
            FROM events JOIN ({_PARSED_SQL}) USING (event_type) JOIN ({_FILTERS_SQL}) AS g USING (event_type),
            (SELECT count(*) AS total FROM events WHERE event_type IN ('click', 'view', 'purchase')) GROUP BY ALL""",
        "w_modifiers": f"""SELECT pattern, all_attributes AS project, g.filter, count(*) AS n, CAST(top_value AS VARCHAR) AS top_value, CAST(has_order_by AS VARCHAR) AS ordered
            FROM events JOIN ({_PARSED_SQL}) USING (event_type) JOIN ({_FILTERS_SQL}) AS g USING (event_type) GROUP BY ALL""",
        "q_insert": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'",
    }
