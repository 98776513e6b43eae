"""Domains and designs drawn in a UML tool and exported as plain XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from pathlib import Path

from ..model import FLAT, Association, Attribute, ClassDef, Design, Domain, End, Generalization, ModelError, SetDef, Struct, Subclass


def _tree(given: str | Path) -> ET.Element:
    text = str(given)
    return ET.fromstring(text) if text.lstrip().startswith("<") else ET.parse(given).getroot()


def _clean(name: str | None) -> str:
    return (name or "").strip().replace(" ", "_")


def _number(text: str | None) -> int | None:
    found = re.search(r"\d+", text or "")
    return int(found[0]) if found else None


def _stereotypes(e: ET.Element) -> list[str]:
    return [s.get("Name", "") for s in e.findall("Stereotypes/Stereotype")]


def _relations(root: ET.Element, kind: str) -> list[ET.Element]:
    return [x for box in root.iter("ModelRelationshipContainer") if box.get("Name") == kind for x in box.findall("ModelChildren/" + kind)]


def _multiplicity(text: str | None) -> tuple[int | None, int | None]:
    """low and high of "1..3", "2", "0..*" (no limit: none)."""
    low, dots, high = (text or "").partition("..")
    if not dots:
        high = low
        low = "0" if low.strip() == "*" else low
    return _number(low), _number(high)


def domain(given: str | Path, name: str = "domain") -> Domain:
    """Classes are called Name#count; an attribute's size is its type modifier and its multiplicity the number of distinct values."""
    root = _tree(given)
    out, by_id = Domain(root.get("Name") or name), {}
    for c in root.iter("Class"):
        if c.get("Id") is None:  # a reference to a class
            continue
        title, _, count = _clean(c.get("Name")).partition("#")
        attributes = tuple(
            Attribute(
                _clean(a.get("Name")),
                a.get("Type") or next((t.get("Name", "") for box in a.findall("Type") for t in box), "") or "String",
                _number(a.get("TypeModifier")),
                _number(a.get("Multiplicity")),
                a.get("IsID", "false").lower() == "true",
            )
            for a in c.findall("ModelChildren/Attribute")
        )
        by_id[c.get("Id")] = title
        out.classes[title] = ClassDef(title, attributes, _number(count))
    for a in _relations(root, "Association"):
        ends = []
        for e in (*a.findall("FromEnd/AssociationEnd"), *a.findall("ToEnd/AssociationEnd")):
            low, high = _multiplicity(e.get("Multiplicity"))
            ends.append(End(_clean(e.get("Name")), by_id[e.get("EndModelElement")], low, high))
        out.associations[_clean(a.get("Name"))] = Association(_clean(a.get("Name")), tuple(ends))
    single = {g.get("Id"): g for g in _relations(root, "Generalization")}
    marks = {s: _clean(a.get("Name")) for a in root.iter("Attribute") for s in _stereotypes(a)}
    for group in root.iter("GeneralizationSet"):
        members = [single[g.get("Idref") or g.get("Id")] for g in group.findall("Generalizations/Generalization") if (g.get("Idref") or g.get("Id")) in single]
        if not members:
            continue
        title = _clean(group.get("Name"))
        subs = []
        for g in members:
            child = by_id[g.get("To")]
            text = _clean(g.get("Name"))
            mark = marks.get(title) or marks.get(text)
            subs.append(Subclass(child, f"{mark}='{text or child}'" if mark else None))
        out.generalizations[title] = Generalization(title, by_id[members[0].get("From")], tuple(subs), group.get("Disjoint", "false").lower() == "true", group.get("Covering", "false").lower() == "true")
    return out


def referenced_domain(given: str | Path) -> str | None:
    """The name of the domain that a design refers to."""
    for r in _tree(given).iter("Reference"):
        if r.get("Description", "").lower() == "domain":
            return Path(r.get("Url", "")).stem
    return None


def design(given: str | Path, of: Domain, paradigm: str = FLAT) -> Design:
    """Packages are sets and structs by their stereotype; a class or association with the stereotype anchor is one.

    An association belongs to the innermost struct around both its ends, or to the one that a stereotype of it names.
    """
    root = _tree(given)
    models = root.find("Models")
    if models is None:
        raise ModelError("there are no models")
    out = Design(of, root.get("Name") or "design", paradigm)
    anchors: dict[str, list[str]] = {}
    parts: dict[str, list[str]] = {}
    order: list[tuple[str, str]] = []
    around: dict[str, list[str]] = {}  # by id, the packages around it, inner ones last

    def package(e: ET.Element, above: list[str]) -> str:
        name, kinds = _clean(e.get("Name")), [s.lower() for s in _stereotypes(e)]
        kind = next((k for k in kinds if k in ("set", "struct")), None)
        if kind is None:
            raise ModelError(f"the package {name} is neither a set nor a struct")
        anchors[name], parts[name] = [], []
        path = [*above, name]
        around[e.get("Id", name)] = path
        parts[name] += [package(x, path) for x in e.findall("ModelChildren/Model")]
        for c in e.findall("ModelChildren/Class"):
            title = _clean(c.get("Name")).partition("#")[0]
            around[c.get("Id", title)] = path
            (anchors if "anchor" in [s.lower() for s in _stereotypes(c)] else parts)[name].append(title)
            parts[name] += [_clean(a.get("Name")) for a in c.findall("ModelChildren/Attribute")]
        order.append((kind, name))
        return name

    for e in models.findall("Model"):
        package(e, [])
    kinds = {name: kind for kind, name in order}
    for a in _relations(root, "Association"):
        first, last = (around.get(a.get(f"EndRelationship{x}MetaModelElement", "")) for x in ("From", "To"))
        if not first or not last:
            continue
        marks = _stereotypes(a)
        common = [x for x, y in zip(first, last, strict=False) if x == y and kinds[x] == "struct"]
        named = [m for m in marks if kinds.get(_clean(m)) == "struct" and _clean(m) in {*first, *last}]
        home = _clean(named[0]) if named else common[-1] if common else None
        if home:
            (anchors if "anchor" in [m.lower() for m in marks] else parts)[home].append(_clean(a.get("Name")))
    for kind, name in order:
        if kind == "set":
            out.sets[name] = SetDef(name, tuple(dict.fromkeys(parts[name])))
        else:
            out.structs[name] = Struct(name, tuple(dict.fromkeys(anchors[name])), tuple(dict.fromkeys(parts[name])))
    return out
