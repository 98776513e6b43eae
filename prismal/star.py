"""The driver's star schema as a domain, with designs over it."""

from __future__ import annotations

from functools import cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import NESTED, Attribute, Design, Domain, End, Subclass
from .operators.catalog import Catalog
from .operators.migrate import migrate
from .plans.paths import table_map

_KINDS = {"i": "Integer", "l": "BIGINT", "d": "FLOAT", "s": "String", "t": "Timestamp"}
# Columns of the tables with their kinds, the identifier first.
CLASSES = {
    "Region": "r_regionkey:i r_name:s",
    "Nation": "n_nationkey:i n_name:s",
    "Customer": "c_custkey:l c_name:s c_acctbal:d c_mktsegment:s",
    "Supplier": "s_suppkey:l s_name:s s_acctbal:d",
    "Part": "p_partkey:l p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "Order": "o_orderkey:l o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "LineItem": "l_id:s l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "Event": "event_id:l ts:t event_type:s value:d",
    "Document": "doc_id:l lang:s source:s n_chars:l",
    "Label": "label_doc:l quality:i toxic:i",
}
# Associations by the end on the one side, its class, the other end, its class, and how many of these there may be.
ASSOCIATIONS = {
    "NationRegion": ("n_regionkey", "Region", "region_nation", "Nation", 1),
    "CustNation": ("c_nationkey", "Nation", "nation_cust", "Customer", 0),
    "SuppNation": ("s_nationkey", "Nation", "nation_supp", "Supplier", 0),
    "OrderCust": ("o_custkey", "Customer", "cust_order", "Order", 0),
    "LineOrder": ("l_orderkey", "Order", "order_line", "LineItem", 0),
    "LinePart": ("l_partkey", "Part", "part_line", "LineItem", 0),
    "LineSupp": ("l_suppkey", "Supplier", "supp_line", "LineItem", 0),
    "EventCust": ("user_id", "Customer", "cust_event", "Event", 0),
    "LabelOf": ("labelled", "Document", "doc_label", "Label", 0),
}
SUBCLASSES = {
    "OrderStatus": ("Order", "o_orderstatus", {"FinishedOrder": "F", "OpenOrder": "O", "PendingOrder": "P"}),
    "EventKind": ("Event", "event_type", {"ClickEvent": "click", "ErrorEvent": "error", "PurchaseEvent": "purchase", "SignupEvent": "signup", "ViewEvent": "view"}),
    "FinishedUrgency": ("FinishedOrder", "o_orderpriority", {"UrgentOrder": "1-URGENT", "HighOrder": "2-HIGH", "MediumOrder": "3-MEDIUM", "UnspecifiedOrder": "4-NOT SPECIFIED", "LowOrder": "5-LOW"}),
    "LineFlag": ("LineItem", "l_returnflag", {"AcceptedLine": "A", "NewLine": "N", "ReturnedLine": "R"}),
}
#: Overlapping and complete: parts are small, large, or both around the middle.
PART_SIZES = {"SmallPart": "p_size <= 30", "LargePart": "p_size >= 20"}
TABLES = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "LineItem": "lineitem", "Event": "events", "Document": "documents", "Label": "labels"}


@cache
def domain() -> Domain:
    d = Domain("star")
    for name, columns in CLASSES.items():
        pairs = [c.split(":") for c in columns.split()]
        d.add_class(name, *[Attribute(a, _KINDS[k], None, None, i == 0) for i, (a, k) in enumerate(pairs)])
    for group, (top, column, kinds) in SUBCLASSES.items():
        for sub in kinds:
            d.add_class(sub)
        d.add_generalization(group, top, *[Subclass(s, f"{column} = '{v}'") for s, v in kinds.items()])
    for sub in PART_SIZES:
        d.add_class(sub)
    d.add_generalization("PartSize", "Part", *[Subclass(s, c) for s, c in PART_SIZES.items()], disjoint=False)
    for name, (one, cls, many, other, low) in ASSOCIATIONS.items():
        d.add_association(name, End(one, cls, 1, 1), End(many, other, low, None))
    return d


def _own(cls: str) -> list[str]:
    return [c.split(":")[0] for c in CLASSES[cls].split()]


def _links(cls: str) -> list[str]:
    return [a for a, (_, _, _, other, _) in ASSOCIATIONS.items() if other == cls]


def _plain(design: Design, cls: str, table: str | None = None) -> None:
    table = table or TABLES[cls]
    design.add_struct(f"{table}_type", [cls], [*_own(cls), *_links(cls)])
    design.add_set(table, f"{table}_type")


def _rest(design: Design, *without: str) -> Design:
    for cls in CLASSES:
        if cls not in without:
            _plain(design, cls)
    return design


@cache
def design(name: str) -> Design:
    out = Design(domain(), name)
    if name == "normalized":
        return _rest(out)
    if name == "vertical":
        out.add_struct("orders_a_type", ["Order"], ["o_orderkey", "o_orderstatus", "o_totalprice", "OrderCust"])
        out.add_set("orders_a", "orders_a_type")
        out.add_struct("orders_b_type", ["Order"], ["o_orderkey", "o_orderdate", "o_orderpriority"])
        out.add_set("orders_b", "orders_b_type")
        return _rest(out, "Order")
    if name == "per_status":
        for sub in SUBCLASSES["OrderStatus"][2]:
            out.add_struct(f"{sub}_type", [sub], [*_own("Order"), "OrderCust"])
            out.add_set(f"{sub}_table", f"{sub}_type")
        return _rest(out, "Order")
    if name == "per_urgency":  # two levels: open and pending orders by status, finished ones by priority
        for sub in [*SUBCLASSES["FinishedUrgency"][2], "OpenOrder", "PendingOrder"]:
            out.add_struct(f"{sub}_type", [sub], [*_own("Order"), "OrderCust"])
            out.add_set(f"{sub}_table", f"{sub}_type")
        return _rest(out, "Order")
    if name in ("per_size", "per_status_size"):
        kinds = {s: "Part" for s in PART_SIZES} | ({s: "Order" for s in SUBCLASSES["OrderStatus"][2]} if name == "per_status_size" else {})
        for sub, top in kinds.items():
            out.add_struct(f"{sub}_type", [sub], [*_own(top), *_links(top)])
            out.add_set(f"{sub}_table", f"{sub}_type")
        return _rest(out, *kinds.values())
    if name == "link_tables":
        for cls, link in (("Order", "OrderCust"), ("LineItem", "LineOrder")):
            out.add_struct(f"{TABLES[cls]}_type", [cls], [*_own(cls), *[a for a in _links(cls) if a != link]])
            out.add_set(TABLES[cls], f"{TABLES[cls]}_type")
            out.add_struct(f"{link}_type", [link])
            out.add_set(f"{link}_table", f"{link}_type")
        return _rest(out, "Order", "LineItem")
    if name == "two_keys":
        out.add_struct("orders_a_type", ["Order"], ["o_orderkey", "o_orderstatus", "o_totalprice", "OrderCust"])
        out.add_set("orders_a", "orders_a_type")
        out.add_struct("orders_b_type", ["Order"], ["o_orderkey", "o_orderdate", "o_orderpriority", "OrderCust"])
        out.add_set("orders_b", "orders_b_type")
        return _rest(out, "Order")
    if name == "denorm_line":
        out.add_struct("lines_type", ["LineItem"], [*_own("LineItem"), "LineOrder", "Order", *_own("Order"), "OrderCust", "Customer", *_own("Customer"), "CustNation", "LinePart", "LineSupp"])
        out.add_set("lines", "lines_type")
        return _rest(out, "LineItem", "Order", "Customer")
    out.paradigm = NESTED
    if name == "nested_orders":
        out.add_struct("item_type", ["LineItem"], [*_own("LineItem"), "LinePart", "LineSupp"])
        out.add_set("items", "item_type")
        out.add_struct("order_type", ["Order"], [*_own("Order"), "OrderCust", "LineOrder", "items"])
        out.add_set("order_docs", "order_type")
        return _rest(out, "LineItem", "Order")
    if name == "nested_customer":
        out.add_struct("region_in", ["Region"], _own("Region"))
        out.add_struct("nation_in", ["Nation"], [*_own("Nation"), "NationRegion", "region_in"])
        out.add_struct("order_in", ["Order"], _own("Order"))
        out.add_set("orders_in", "order_in")
        out.add_struct("customer_type", ["Customer"], [*_own("Customer"), "CustNation", "nation_in", "OrderCust", "orders_in"])
        out.add_set("customer_docs", "customer_type")
        return _rest(out, "Customer", "Order", "Nation", "Region")
    if name == "two_sets":
        out.add_struct("order_in", ["Order"], _own("Order"))
        out.add_set("orders_in", "order_in")
        out.add_struct("event_in", ["Event"], _own("Event"))
        out.add_set("events_in", "event_in")
        out.add_struct("customer_type", ["Customer"], [*_own("Customer"), "CustNation", "OrderCust", "orders_in", "EventCust", "events_in"])
        out.add_set("customer_docs", "customer_type")
        return _rest(out, "Customer", "Order", "Event")
    if name == "id_list":
        out.add_set("customer_ids", "Customer")
        out.add_struct("nation_type", ["Nation"], [*_own("Nation"), "NationRegion", "CustNation", "customer_ids"])
        out.add_set("nation_docs", "nation_type")
        out.add_struct("customer_type", ["Customer"], _own("Customer"))
        out.add_set("customers", "customer_type")
        return _rest(out, "Nation", "Customer")
    raise KeyError(name)


def base(spark: SparkSession, sf_dir: str) -> Catalog:
    """The files as the normalised design; lines get an identity of 128 bits from all their columns (equal lines are one), labels one from their document."""

    def reader(table: str):
        def read():
            df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            if table == "lineitem":
                df = df.withColumn("l_id", F.concat(F.hex(F.xxhash64(*df.columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *df.columns))))
            elif table == "labels":
                df = df.select(F.col("doc_id").alias("label_doc"), F.col("doc_id").alias("labelled"), "quality", "toxic")
            return df.select(*[f.name for f in table_map(design("normalized"), table).schema])

        return read

    return Catalog(spark, design("normalized"), {t: reader(t) for t in TABLES.values()})


def catalog(spark: SparkSession, sf_dir: str, name: str) -> Catalog:
    source = base(spark, sf_dir)
    return source if name == "normalized" else migrate(source, design(name))
