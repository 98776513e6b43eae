"""Domains, designs, queries and inserts as JSON, and settings as key=value lines."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from ..model import FLAT, NESTED, Association, Attribute, ClassDef, Design, Domain, End, Generalization, Guard, InsertSpec, ModelError, QuerySpec, SetDef, Struct, Subclass


def _read(given: str | Path | dict) -> tuple[dict, str]:
    if isinstance(given, dict):
        return given, "unnamed"
    with open(given, encoding="utf-8") as f:
        return json.load(f), Path(given).stem


def _flag(x: Any) -> bool:
    return x is True or str(x).lower() == "true"


def domain(given: str | Path | dict) -> Domain:
    """A domain as it is written, right or not; plans.checks tells what is wrong."""
    raw, name = _read(given)
    out = Domain(raw.get("name", name))
    for c in raw.get("classes", ()):
        attributes = tuple(
            Attribute(a["name"], p.get("DataType", "String"), p.get("Size"), p.get("DistinctVals"), _flag(p.get("Identifier", False))) for a in c.get("attr", ()) for p in (a.get("prop", {}),)
        )
        if c["name"] in out.classes:
            raise ModelError(f"two classes {c['name']}")
        out.classes[c["name"]] = ClassDef(c["name"], attributes, c.get("prop", {}).get("Count"))
    for a in raw.get("associations", ()):
        ends = tuple(End(p.get("End_name", ""), e["class"], p.get("MultiplicityMin"), p.get("MultiplicityMax")) for e in a.get("ends", ()) for p in (e.get("prop", {}),))
        out.associations[a["name"]] = Association(a["name"], ends)
    for g in raw.get("generalizations", ()):
        p = g.get("prop", {})
        subs = tuple(Subclass(s["class"], s.get("prop", {}).get("Constraint")) for s in g.get("subclasses", ()))
        out.generalizations[g["name"]] = Generalization(g["name"], g["superclass"], subs, p.get("Disjoint"), p.get("Complete"))
    out.guards = [Guard(tuple(x["pattern"]), tuple(x["data"])) for x in raw.get("guards", ())]
    return out


def domain_json(d: Domain) -> dict:
    """The JSON form of a domain."""
    return {
        "name": d.name,
        "classes": [
            {"name": c.name, "prop": {"Count": c.count}, "attr": [{"name": a.name, "prop": {"DataType": a.type, "Size": a.size, "DistinctVals": a.distinct, "Identifier": a.identifier}} for a in c.attributes]}
            for c in d.classes.values()
        ],
        "associations": [
            {"name": a.name, "ends": [{"class": e.cls, "prop": {"End_name": e.name, "MultiplicityMin": e.low, "MultiplicityMax": e.high}} for e in a.ends]} for a in d.associations.values()
        ],
        "generalizations": [
            {"name": g.name, "prop": {"Disjoint": g.disjoint, "Complete": g.complete}, "superclass": g.superclass, "subclasses": [{"class": s.cls, "prop": {"Constraint": s.constraint}} for s in g.subclasses]}
            for g in d.generalizations.values()
        ],
        "guards": [{"pattern": list(g.pattern), "data": list(g.data)} for g in d.guards],
    }


def design(given: str | Path | dict, of: Domain | None = None, paradigm: str | None = None) -> Design:
    """A design; without a domain at hand, the one that it names is read from beside it or from a folder domains above it."""
    raw, name = _read(given)
    if of is None:
        if isinstance(given, dict):
            raise ModelError("a design needs its domain")
        here = Path(given).resolve().parent
        places = [here, *[p / "domains" for p in here.parents]]
        found = next((p / f"{raw['domain']}.json" for p in places if (p / f"{raw['domain']}.json").is_file()), None)
        if found is None:
            raise ModelError(f"there is no domain {raw['domain']}")
        of = domain(found)
    out = Design(of, raw.get("name", name), paradigm or raw.get("paradigm") or FLAT)
    for e in raw.get("hyperedges", ()):
        if e["kind"] == "Struct":
            out.structs[e["name"]] = Struct(e["name"], tuple(e.get("anchor", ())), tuple(e.get("elements", ())))
        elif e["kind"] == "Set":
            out.sets[e["name"]] = SetDef(e["name"], tuple(e.get("elements", ())))
        else:
            raise ModelError(f"{e['name']}: {e['kind']} is neither Struct nor Set")
    if paradigm is None and "paradigm" not in raw and any(out.containers(x) for x in out.sets):
        out.paradigm = NESTED
    return out


def design_json(d: Design) -> dict:
    edges: dict[str, dict] = {}

    def put(name: str) -> None:
        if name in edges or not (name in d.structs or name in d.sets):
            return
        x = d.structs.get(name) or d.sets[name]
        for e in x.parts if isinstance(x, Struct) else x.elements:
            put(e)
        edges[name] = {"kind": "Struct", "name": name, "anchor": list(x.anchor), "elements": list(x.elements)} if isinstance(x, Struct) else {"kind": "Set", "name": name, "elements": list(x.elements)}

    for name in (*d.structs, *d.sets):
        put(name)
    return {"name": d.name, "domain": d.domain.name, "paradigm": d.paradigm, "hyperedges": list(edges.values())}


def queries(given: str | Path | dict) -> list[QuerySpec]:
    return [QuerySpec.of(q) for q in _read(given)[0].get("queries", ())]


def inserts(given: str | Path | dict) -> list[InsertSpec]:
    return [InsertSpec.of(x) for x in _read(given)[0].get("insertions", ())]


def settings(path: str | Path, required: tuple[str, ...] = ()) -> dict[str, str]:
    """key=value lines; blank lines and those that begin with # are skipped."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            key, eq, value = line.partition("=")
            if not eq:
                raise ModelError(f"not key=value: {line}")
            out[key.strip()] = value.strip()
    missing = [k for k in required if k not in out]
    if missing:
        raise ModelError(f"the settings lack {', '.join(missing)}")
    return out
