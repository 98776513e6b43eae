"""Models over the sales part of the star domain with one fault each, by the code of the constraint that tells of it; and queries that are refused."""

from __future__ import annotations

import copy
from collections.abc import Callable

from . import star
from .model import FLAT, NESTED, Association, Attribute, ClassDef, Design, Domain, End, Generalization, Guard, SetDef, Struct, Subclass
from .plans import checks


def domain(**parts) -> Domain:
    """The star domain without its texts, with some classes, associations or generalizations replaced or added."""
    out = copy.deepcopy(star.domain())
    for x in ("Document", "Label"):
        del out.classes[x]
    del out.associations["LabelOf"]
    for kind, new in parts.items():
        getattr(out, kind).update({x.name: x for x in new})
    return out


def design(name: str = "normalized", paradigm: str = FLAT, structs=(), sets=(), without=()) -> Design:
    """A design of that domain with some of its structs and sets replaced, added or taken away."""
    out = copy.deepcopy(star.design(name))
    out.domain, out.paradigm = domain(), paradigm
    for x in ("documents", "labels"):
        del out.sets[x], out.structs[f"{x}_type"]
    out.structs.update({x.name: x for x in structs})
    out.sets.update({x.name: x for x in sets})
    for x in without:
        out.structs.pop(x, None)
        out.sets.pop(x, None)
    return out


def _class(name: str, *attributes: str, key: str | None = None, count: int | None = None, **distinct: int) -> ClassDef:
    return ClassDef(name, tuple(Attribute(a, distinct=distinct.get(a), identifier=a == key) for a in attributes), count)


def _kinds(name: str, top: str, *subs: Subclass, known: bool = True) -> Generalization:
    return Generalization(name, top, subs, True, True) if known else Generalization(name, top, subs)


def _table(*structs: Struct) -> dict:
    return {"structs": structs, "sets": [SetDef("extra", tuple(s.name for s in structs[-1:]))]}


_DEEP = [Struct("flag_in", ("LineItem",), ("l_id",)), Struct("order_in", ("Order",), ("o_orderkey", "LineOrder", "flags")), Struct("extra_type", ("Customer",), ("c_custkey", "OrderCust", "orders_in"))]

DOMAINS: dict[str, Callable[[], Domain]] = {
    "Empty": Domain,
    "Generic1": lambda: domain(classes=[_class("Port", "r_name", key="r_name")]),
    "Generic2": lambda: domain(classes=[_class("Port", "port_no", key="port_no")]),
    "Generic3": lambda: domain(associations=[Association("Ships", (End("ships_order", "Order", 0, 1), End("ships_port", "Port", 0, 1)))]),
    "Generic5": lambda: domain(classes=[_class("Port")]),
    "Atoms4": lambda: domain(classes=[_class("Port", "port_no", "s_name", key="port_no")]),
    "Atoms5": lambda: domain(classes=[_class("Region", "r_regionkey", "r_name", key="r_regionkey", count=5, r_regionkey=5, r_name=7)]),
    "Atoms7": lambda: domain(associations=[Association("SuppNation", (End("s_nationkey", "Nation", 1, 1),))]),
    "Atoms8": lambda: domain(classes=[_class("Region", "r_regionkey", "r_name", key="r_regionkey", count=5, r_regionkey=3)]),
    "Atoms9": lambda: domain(generalizations=[_kinds("A", "Supplier", Subclass("Region", "s_suppkey = 1")), _kinds("B", "Part", Subclass("Region", "p_size = 1"))]),
    "Atoms10": lambda: domain(generalizations=[_kinds("A", "Supplier", Subclass("Region"))]),
    "Atoms11": lambda: domain(generalizations=[_kinds("A", "Supplier", Subclass("Region", "s_suppkey = 1"), known=False)]),
    "Atoms12": lambda: domain(generalizations=[_kinds("A", "Supplier", Subclass("Region", "s_suppkey = 1")), _kinds("B", "Region", Subclass("Supplier", "r_regionkey = 1"))]),
    "Atoms13": lambda: domain(classes=[_class("Region", "r_regionkey", "r_name")]),
    "Atoms14": lambda: domain(generalizations=[_kinds("A", "Supplier", Subclass("Region", "s_suppkey = 1"))]),
    "Atoms15": lambda: domain(classes=[_class("Supplier", "s_name")], generalizations=[_kinds("A", "Supplier", Subclass("Region", "s_name = 'x'"))]),
    "Atoms16": lambda: domain(generalizations=[_kinds("A", "Supplier", Subclass("Region", "p_size = 1"))]),
    "Atoms17": lambda: domain(associations=[Association("SuppNation", (End("", "Nation", 1, 1), End("nation_supp", "Supplier", 0, 1)))]),
}

DESIGNS: dict[str, Callable[[], Design]] = {
    "Generic4": lambda: design(sets=[SetDef("extra", ())]),
    "Generic7": lambda: design(**_table(Struct("one", ("Part",), ("two",)), Struct("two", ("Part",), ("one",)))),
    "Sets3": lambda: design(sets=[SetDef("extra", ("p_name",))]),
    "Sets4": lambda: design(sets=[SetDef("extra", ("part",))]),
    "Sets5": lambda: design(sets=[SetDef("extra", ("LinePart",))]),
    "Sets6": lambda: design(sets=[SetDef("extra", ("OrderStatus",))]),
    "Sets7": lambda: design(sets=[SetDef("extra", ("Part", "Nation"))]),
    "Structs2": lambda: design(structs=[Struct("lonely", ("Part",), ("p_partkey",))]),
    "Structs3": lambda: design(**_table(Struct("extra_type", (), ("p_partkey",)))),
    "Structs4": lambda: design(**_table(Struct("extra_type", ("p_partkey",), ()))),
    "Structs5": lambda: design(**_table(Struct("extra_type", ("Part", "Region"), ()))),
    "Structs6": lambda: design(**_table(Struct("extra_type", ("Order",), ("OpenOrder",)))),
    "Structs8": lambda: design(**_table(Struct("extra_type", ("OpenOrder",), ("PendingOrder",)))),
    "Structs-b": lambda: design(**_table(Struct("extra_type", ("Part",), ("p_partkey", "r_name")))),
    "Structs-c": lambda: design(paradigm=NESTED, **_table(Struct("region_in", ("Region",), ("r_regionkey",)), Struct("extra_type", ("Part",), ("p_partkey", "region_in")))),
    "Structs-d": lambda: design(paradigm=NESTED, structs=[Struct("extra_type", ("Part",), ("p_partkey", "regions_in"))], sets=[SetDef("regions_in", ("Region",)), SetDef("extra", ("extra_type",))]),
    "Structs-e": lambda: design(**_table(Struct("extra_type", ("Part",), ("Region",)))),
    "Design2": lambda: design(without=["region", "region_type"]),
    "Design4": lambda: design(structs=[Struct("extra_type", ("Region",), ("r_regionkey",))], sets=[SetDef("part", ("part_type", "extra_type"))]),
    "Design5": lambda: design(structs=[Struct("extra_type", ("Part",), ("p_partkey",))], sets=[SetDef("part", ("part_type", "extra_type"))]),
    "Relational1": lambda: design(paradigm=NESTED, structs=_DEEP, sets=[SetDef("flags", ("flag_in",)), SetDef("orders_in", ("order_in",)), SetDef("extra", ("extra_type",))]),
    "FirstNormalForm1": lambda: design("nested_orders"),
    "FirstNormalForm2": lambda: design(sets=[SetDef("extra", ("Part",))]),
    "FirstNormalForm3": lambda: design(**_table(Struct("nation_in", ("Nation",), ("n_nationkey",)), Struct("extra_type", ("Supplier",), ("s_suppkey", "SuppNation", "nation_in")))),
    "FirstNormalForm4": lambda: design(**_table(Struct("extra_type", ("Nation",), ("n_nationkey", "SuppNation", "Supplier")))),
    "Guard": lambda: _guarded(),
}


def _guarded() -> Design:
    """Parts have to be insertable by themselves, and stand in rows of lines only."""
    d = domain()
    d.guards.append(Guard(("Part",), ("p_partkey", "p_name")))
    out, own = Design(d, "guarded"), {c: [x.split(":")[0] for x in columns.split()] for c, columns in star.CLASSES.items()}
    for cls, columns in own.items():
        if cls in d.classes and cls not in ("LineItem", "Part"):
            out.add_struct(f"{cls}_type", [cls], [*columns, *[a for a, x in star.ASSOCIATIONS.items() if x[3] == cls]])
            out.add_set(f"{cls}_table", f"{cls}_type")
    out.add_struct("lines_type", ["LineItem"], [*own["LineItem"], "LineOrder", "LineSupp", "LinePart", "Part", *own["Part"]])
    out.add_set("lines", "lines_type")
    return out


#: Queries that are refused, by why.
QUERIES: dict[str, dict] = {
    "no pattern": {"project": ["p_name"], "pattern": []},
    "no projection": {"project": [], "pattern": ["Part"]},
    "no such class": {"project": ["p_name"], "pattern": ["Port"]},
    "no such attribute": {"project": ["port_no"], "pattern": ["Part"]},
    "not connected": {"project": ["p_name", "r_name"], "pattern": ["Part", "Region"]},
    "outside the pattern": {"project": ["r_name"], "pattern": ["Part"]},
    "no predicate": {"project": ["p_name"], "pattern": ["Part"], "filter": "p_size = = 1"},
    "no value": {"project": ["p_name"], "pattern": ["Part"], "filter": "p_size = $1"},
}


def errors(code: str) -> set[str]:
    """Codes of the errors that the model with this fault gives."""
    found = checks.check_domain(DOMAINS[code]()) if code in DOMAINS else checks.check(DESIGNS[code]())
    return {v.code for v in found if v.severity == checks.ERROR}
