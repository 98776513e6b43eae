"""Domains and designs as text."""

from __future__ import annotations

from ..model import Design, Domain
from .paths import loose_ends, table_map


def domain(d: Domain) -> str:
    out = [f"domain {d.name}"]
    for c in d.classes.values():
        above = f" < {d.parent(c.name)}" if d.parent(c.name) else ""
        out.append(f"  class {c.name}{above} ({c.count if c.count is not None else '?'})")
        out += [f"    {a.name} {a.type}{f'({a.size})' if a.size else ''}{' identifier' if a.identifier else ''}" for a in c.attributes]
    for a in d.associations.values():
        out.append(f"  association {a.name}: " + ", ".join(f"{e.name} -> {e.cls} {e.low}..{e.high if e.high is not None else '*'}" for e in a.ends))
    for g in d.generalizations.values():
        kind = f"{'disjoint' if g.disjoint else 'overlapping'}, {'complete' if g.complete else 'incomplete'}"
        out.append(f"  generalization {g.name} of {g.superclass} ({kind}): " + ", ".join(f"{s.cls} if {s.constraint}" for s in g.subclasses))
    return "\n".join(out)


def design(x: Design) -> str:
    out = [f"design {x.name} of {x.domain.name}, {x.paradigm}"]
    for t in x.tables():
        out.append(f"  table {t}: {table_map(x, t).schema.simpleString()}")
    for s in x.structs.values():
        out.append(f"  struct {s.name} anchored on {', '.join(s.anchor)}: {', '.join(s.elements)}" + (f"; loose ends {', '.join(loose_ends(x, s))}" if loose_ends(x, s) else ""))
    return "\n".join(out)
