"""Integrity constraints of domains and designs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from ..model import FLAT, Design, Domain, ModelError, Struct
from .paths import loose_ends, present_classes, sets_of, table_map

ERROR, WARNING = "error", "warning"


@dataclass(frozen=True)
class Violation:
    code: str
    severity: str
    elements: tuple[str, ...]

    def __str__(self) -> str:
        return f"{self.code}: {', '.join(self.elements)}"


def _bad(code: str, elements, severity: str = ERROR) -> Iterator[Violation]:
    elements = tuple(dict.fromkeys(elements))
    if elements:
        yield Violation(code, severity, elements)


def _cyclic(edges: dict[str, list[str]]) -> list[str]:
    """Elements that reach themselves."""
    out = []
    for start in edges:
        seen, todo = set(), list(edges[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += edges.get(x, [])
        if start in seen:
            out.append(start)
    return out


def _groups(links: list[set[str]]) -> list[set[str]]:
    out: list[set[str]] = []
    for link in links:
        touching = [g for g in out if g & link]
        out = [g for g in out if not g & link] + [set().union(link, *touching)]
    return out


def check_domain(d: Domain) -> list[Violation]:
    return list(_domain(d))


def _domain(d: Domain) -> Iterator[Violation]:
    if not d.classes:
        yield from _bad("Empty", ["no classes"])
        return
    owners = Counter(a.name for c in d.classes.values() for a in c.attributes)
    names = Counter([*d.classes, *d.associations, *d.generalizations, *owners.elements(), *[e.name for a in d.associations.values() for e in a.ends if e.name]])
    yield from _bad("Generic1", [n for n, k in names.items() if k > 1])
    known = set(d.classes)
    ends = [e for a in d.associations.values() for e in a.ends]
    yield from _bad("Generic3", [e.cls for e in ends if e.cls not in known] + [c for g in d.generalizations.values() for c in (g.superclass, *[s.cls for s in g.subclasses]) if c not in known])
    links = [{c} for c in d.classes] + [{e.cls for e in a.ends} for a in d.associations.values()] + [{g.superclass, *[s.cls for s in g.subclasses]} for g in d.generalizations.values()]
    groups = _groups([x for x in links if x])
    yield from _bad("Generic2", [min(g) for g in groups] if len(groups) > 1 else [])
    parents = {c: [g.superclass for g in d.generalizations.values() for s in g.subclasses if s.cls == c] for c in d.classes}
    cycles = _cyclic(parents)
    yield from _bad("Atoms12", cycles)
    yield from _bad("Generic5", [c.name for c in d.classes.values() if not c.attributes and not parents[c.name]] + [g.name for g in d.generalizations.values() if not g.subclasses])
    yield from _bad("Atoms4", [n for n, k in owners.items() if k > 1])
    yield from _bad("Atoms5_pre", [a.name for c in d.classes.values() for a in c.attributes if a.distinct is None or c.count is None], WARNING)
    sized = [(c, a) for c in d.classes.values() for a in c.attributes if a.distinct is not None and c.count is not None]
    yield from _bad("Atoms5", [a.name for c, a in sized if a.distinct > c.count])
    yield from _bad("Atoms7", [a.name for a in d.associations.values() if len(a.ends) != 2])
    yield from _bad("Atoms8", [a.name for c, a in sized if a.identifier and a.distinct != c.count])
    yield from _bad("Atoms9", [c for c, p in parents.items() if len(set(p)) > 1])
    yield from _bad("Atoms10", [s.cls for g in d.generalizations.values() for s in g.subclasses if not s.constraint])
    yield from _bad("Atoms11", [g.name for g in d.generalizations.values() if g.disjoint is None or g.complete is None])
    yield from _bad("Atoms17", [a.name for a in d.associations.values() for e in a.ends if not e.name or e.low is None or e.high is None and e.low is None])
    if cycles:
        return
    ids = {c: [a.name for a in d.classes[c].attributes if a.identifier] for c in d.classes}
    yield from _bad("Atoms13", [c for c in d.classes if not ids[c] and not parents[c]])
    yield from _bad("Atoms14", [c for c in d.classes if sum(len(ids.get(x, ())) for x in d.line(c)) > 1])
    yield from _bad("Atoms15", [c for c in d.classes if parents[c] and not ids.get(d.root(c))])
    for g in d.generalizations.values():
        above = {a.name for c in d.line(g.superclass) for a in d.classes[c].attributes} if g.superclass in known else set()
        yield from _bad("Atoms16", [s.cls for s in g.subclasses if s.constraint and not set(constraint_names(s.constraint)) <= above])


_TOKEN = re.compile(r"'(?:[^']|'')*'|[A-Za-z_]\w*|\S")
# Words of predicates that are no names.
_WORDS = frozenset("and or not in is null between like true false".split())


def constraint_names(text: str) -> list[str]:
    """Names in a constraint; a light scan, as checks run without Spark."""
    return [t for t in _TOKEN.findall(text) if re.match(r"[A-Za-z_]", t) and t.lower() not in _WORDS]


def check(design: Design) -> list[Violation]:
    """All violations of a design and its domain; later stages run only if the earlier ones found no error."""
    out = check_domain(design.domain)
    for stage in (_containment, _sets, _structs, _design, _paradigm, _guards):
        if any(v.severity == ERROR for v in out):
            break
        out += stage(design)
    return out


def consistent(design: Design) -> bool:
    return not any(v.severity == ERROR for v in check(design))


def _parts(design: Design, name: str) -> tuple[str, ...]:
    return design.structs[name].parts if name in design.structs else design.sets[name].elements


def _containment(design: Design) -> Iterator[Violation]:
    d = design.domain
    every = [*design.structs, *design.sets]
    yield from _bad("Generic1", [n for n, k in Counter([*every, *d.names]).items() if k > 1])
    yield from _bad("Generic3", [e for n in every for e in _parts(design, n) if e not in every and e not in d.names])
    yield from _bad("Generic4", [n for n in every if not _parts(design, n)])
    yield from _bad("Generic7", _cyclic({n: [e for e in _parts(design, n) if e in every] for n in every}))


def _sets(design: Design) -> Iterator[Violation]:
    d = design.domain
    for s in design.sets.values():
        yield from _bad("Sets2", [] if s.elements else [s.name])
        yield from _bad("Sets3", [e for e in s.elements if d.is_attribute(e) or d.is_end(e)])
        yield from _bad("Sets4", [e for e in s.elements if e in design.sets])
        yield from _bad("Sets5", [e for e in s.elements if e in d.associations])
        yield from _bad("Sets6", [e for e in s.elements if e in d.generalizations])
        yield from _bad("Sets7", [s.name] if any(e in d.classes for e in s.elements) and len(s.elements) > 1 else [])


def _links(design: Design, struct: Struct) -> list[set[str]]:
    """What belongs together in a struct: classes of a hierarchy, ends of associations, attributes, and what is nested."""
    d, out = design.domain, []
    for e in struct.parts:
        if e in d.classes:
            out.append({d.root(e)})
        elif e in d.associations:
            out.append({f"<{e}>", *(d.root(x.cls) for x in d.associations[e].ends)})
        elif d.is_attribute(e):
            out.append({d.root(d.owner(e))})
        elif e in design.structs:
            out += _links(design, design.structs[e])
        elif e in design.sets:
            for x in design.sets[e].elements:
                out += _links(design, design.structs[x]) if x in design.structs else [{d.root(x)}]
    return out


def _set_classes(design: Design, name: str) -> set[str]:
    out: set[str] = set()
    for e in design.sets[name].elements:
        out |= present_classes(design, design.structs[e]) if e in design.structs else {e} & set(design.domain.classes)
    return out


def paths_between(design: Design, struct: Struct, start: str, goals: set[str]) -> list[tuple[bool, bool]]:
    """For each simple path over the struct's associations from a root class to one of goals: whether all steps are to one, and to at least one."""
    d = design.domain
    steps: dict[str, list[tuple[str, str, bool, bool]]] = {}
    for a in _associations(design, struct):
        for here, there in (d.associations[a].ends, d.associations[a].ends[::-1]):
            steps.setdefault(d.root(here.cls), []).append((a, d.root(there.cls), there.high is not None and there.high <= 1, (there.low or 0) >= 1))
    out = []

    def walk(at: str, seen: frozenset[str], one: bool, least: bool) -> None:
        if at in goals:
            out.append((one, least))
            return
        for a, to, to_one, at_least in steps.get(at, ()):
            if to not in seen and a not in seen:
                walk(to, seen | {to, a}, one and to_one, least and at_least)

    walk(start, frozenset({start}), True, True)
    return out


def _associations(design: Design, struct: Struct) -> set[str]:
    out = set()
    for e in struct.parts:
        if e in design.domain.associations:
            out.add(e)
        elif e in design.structs:
            out |= _associations(design, design.structs[e])
        elif e in design.sets:
            for x in design.sets[e].elements:
                if x in design.structs:
                    out |= _associations(design, design.structs[x])
    return out


def _anchor_roots(design: Design, struct: Struct) -> set[str]:
    d = design.domain
    return {d.root(c) for a in struct.anchor for c in ([e.cls for e in d.associations[a].ends] if a in d.associations else [a])}


def _discriminants(design: Design, cls: str) -> set[str]:
    text = design.domain.constraint(cls)
    return set(constraint_names(text)) if text else set()


def _structs(design: Design) -> Iterator[Violation]:
    d = design.domain
    for s in design.structs.values():
        yield from _bad("Structs2", [] if design.containers(s.name) else [s.name])
        yield from _bad("Structs3", [] if s.anchor else [s.name])
        yield from _bad("Structs4", [a for a in s.anchor if a not in d.classes and a not in d.associations])
        if not s.anchor or any(a not in d.classes and a not in d.associations for a in s.anchor):
            continue
        anchor = [{d.root(a)} if a in d.classes else {f"<{a}>", *(d.root(e.cls) for e in d.associations[a].ends)} for a in s.anchor]
        yield from _bad("Structs5", [s.name] if len(_groups(anchor)) > 1 else [])
        classes = [e for e in s.parts if e in d.classes]
        yield from _bad("Structs6", [s.name for i, a in enumerate(classes) for b in classes[i + 1 :] if a in d.supers(b) or b in d.supers(a)])
        loose = loose_ends(design, s)
        ends = {e.name for a in s.anchor if a in d.associations for e in d.associations[a].ends}
        only = loose_ends(design, Struct(s.name, s.anchor, ()))
        yield from _bad("Structs7", [e for e in ends & set(only) if e not in loose and not {*d.line(d.end(e).cls), *d.below(d.end(e).cls)} & present_classes(design, s)])
        siblings = [c for c in classes for b in classes if c != b and d.root(c) == d.root(b) and c not in d.supers(b) and b not in d.supers(c)]
        yield from _bad("Structs8", [c for c in siblings if not _discriminants(design, c) <= set(s.parts)])
        groups = _groups(_links(design, s))
        yield from _bad("Structs-e", [s.name] if len(groups) > 1 else [])
        goals = _anchor_roots(design, s)
        own = [d.owner(e) for e in s.parts if d.is_attribute(e)]
        for c in dict.fromkeys(own):
            found = paths_between(design, s, d.root(c), goals)
            yield from _bad("Structs-b", [s.name] if len(found) != 1 else [])
        for e in s.parts:
            if e in design.structs:
                inner = _anchor_roots(design, design.structs[e])
                back = [p for g in goals for p in paths_between(design, s, g, inner)]
                yield from _bad("Structs-c", [e] if not back or (not any(one for one, _ in back)) else [])
            elif e in design.sets:
                inside = {d.root(c) for c in _set_classes(design, e)} | {d.root(x.cls) for y in design.sets[e].elements if y in design.structs for a in _associations(design, design.structs[y]) for x in d.associations[a].ends}
                yield from _bad("Structs-d", [e] if not any(paths_between(design, s, g, inside) for g in goals) else [])


def _design(design: Design) -> Iterator[Violation]:
    d = design.domain
    yield from _bad("Design1", [x for x in design.first_level() if x not in design.sets])
    maps = [table_map(design, t) for t in design.tables()]
    stored = {a for m in maps for a in m.attributes} | {a for m in maps for a in m.associations}
    yield from _bad("Design2", [x for x in (*[a.name for c in d.classes.values() for a in c.attributes], *d.associations) if x not in stored])
    inside = {e for n in (*design.structs, *design.sets) for e in _parts(design, n)}
    generalised = {c for c in d.classes if d.below(c) & inside}
    yield from _bad("Design3", [x for x in (*d.classes, *d.associations) if x not in inside and x not in generalised], WARNING)
    for s in design.sets.values():
        mine = [design.structs[e] for e in s.elements if e in design.structs]
        if len(mine) < 2:
            continue
        keys = [frozenset(d.root(a) if a in d.classes else a for a in x.anchor) for x in mine]
        yield from _bad("Design4", [s.name] if len(set(keys)) > 1 else [])
        yield from _bad("Design5", [s.name] if len({x.anchor for x in mine}) < len(mine) else [])
        yield from _bad("Design6", [a for x in mine for a in x.anchor if a in d.classes and not _discriminants(design, a) <= set(table_map(design, s.name).attributes if s.name in design.tables() else x.parts)])
        places: dict[str, set] = {}
        for x in mine:
            for e in x.parts:
                if e in design.structs or e in design.sets:
                    for c in present_classes(design, design.structs[e]) if e in design.structs else _set_classes(design, e):
                        places.setdefault(d.identifier(c), set()).add(e)
                elif d.is_attribute(e):
                    places.setdefault(e, set()).add("")
        yield from _bad("Design9", [a for a, p in places.items() if len(p) > 1])
    for s in design.structs.values():
        for c in (e for e in s.parts if e in d.classes):
            need = {a for b in d.children(c) for a in _discriminants(design, b)}
            yield from _bad("Design7", [c] if need - set(s.parts) else [], WARNING)
    for c in d.classes:
        holders = [design.structs[s] for s in design.structs if {c, *d.supers(c), *d.below(c)} & set(design.structs[s].parts)]
        anchored = any(d.root(c) in _anchor_roots(design, s) for s in holders)
        sure = anchored or any(least for s in holders for _, least in paths_between(design, s, d.root(c), _anchor_roots(design, s)))
        yield from _bad("Design8", [c] if holders and not sure else [], WARNING)


def _paradigm(design: Design) -> Iterator[Violation]:
    for m in (table_map(design, t) for t in design.tables()):
        yield from _bad("Relational1", [m.name] if any(len(sets_of(p)) > 1 for p in m.columns) else [])
    if design.paradigm != FLAT:
        return
    d = design.domain
    yield from _bad("FirstNormalForm1", [s for s in design.sets if s not in design.first_level()])
    yield from _bad("FirstNormalForm2", [s.name for s in design.sets.values() if any(e not in design.structs for e in s.elements)])
    yield from _bad("FirstNormalForm3", [s for s in design.structs if any(c not in design.first_level() for c in design.containers(s))])
    for s in design.structs.values():
        many = [c for c in present_classes(design, s) if d.root(c) not in _anchor_roots(design, s) and not any(one for g in _anchor_roots(design, s) for one, _ in paths_between(design, s, g, {d.root(c)}))]
        many += [e for e in loose_ends(design, s) if not any(a in s.anchor for a in [d.association_of(e).name]) and (d.end(e).high is None or d.end(e).high > 1)]
        yield from _bad("FirstNormalForm4", many)


def _guards(design: Design) -> Iterator[Violation]:
    from ..operators.insert import insertion_points

    for g in design.domain.guards:
        try:
            found, _ = insertion_points(design, g.pattern, set(g.data))
        except ModelError:
            found = []
        yield from _bad("Guard", [] if found else g.pattern)
