"""Where each table of a design keeps attributes, class identities and association ends."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import types as T

from ..model import Design, ModelError, Struct


@dataclass(frozen=True)
class Hop:
    kind: str  # "struct", "set" or "leaf"
    name: str


Path = tuple[Hop, ...]


def sets_of(path: Path) -> list[Path]:
    """The sets that a path goes through, as prefixes of it, outer ones first."""
    return [path[: i + 1] for i, h in enumerate(path) if h.kind == "set"]


@dataclass
class TableMap:
    """A table of a design. columns: every leaf by path; attributes, classes, ends: name to path; associations: names in it."""

    design: Design
    name: str
    columns: dict[Path, str] = field(default_factory=dict)
    attributes: dict[str, Path] = field(default_factory=dict)
    classes: dict[str, Path] = field(default_factory=dict)
    loose: dict[str, Path] = field(default_factory=dict)
    associations: set[str] = field(default_factory=set)
    inside: dict[str, set[str]] = field(default_factory=dict)  # struct to the classes in it
    where: dict[str, set[Path]] = field(default_factory=dict)  # association to the prefixes at which it stands

    def __post_init__(self) -> None:
        self._set(self.name, ())

    def _leaf(self, name: str, path: Path) -> Path:
        path = (*path, Hop("leaf", name))
        self.columns.setdefault(path, name)
        return path

    def _identity(self, cls: str, prefix: Path) -> None:
        name = self.design.domain.identifier(cls)
        path = self._leaf(name, prefix)
        self.classes.setdefault(cls, path)
        self.attributes.setdefault(name, path)

    def _set(self, name: str, prefix: Path) -> None:
        for e in self.design.sets[name].elements:
            if e in self.design.structs:
                self._struct(self.design.structs[e], prefix)
            elif e in self.design.domain.classes:
                self._identity(e, prefix)

    def _struct(self, struct: Struct, prefix: Path) -> None:
        d = self.design.domain
        for e in struct.parts:
            if e in d.classes:
                self._identity(e, prefix)
            elif e in d.associations:
                self.associations.add(e)
                self.where.setdefault(e, set()).add(prefix)
                for end in d.associations[e].ends:
                    if end.name in loose_ends(self.design, struct):
                        self.loose.setdefault(end.name, self._leaf(end.name, prefix))
            elif e in self.design.structs:
                self._struct(self.design.structs[e], (*prefix, Hop("struct", e)))
            elif e in self.design.sets:
                self._set(e, (*prefix, Hop("set", e)))
            elif d.is_attribute(e):
                self.attributes.setdefault(e, self._leaf(e, prefix))
        self.inside[struct.name] = {e for e in struct.parts if e in d.classes}

    def end_path(self, end: str) -> Path | None:
        """The column of an end: its own if loose, else the identity of its class, where its association stands in this table."""
        if end in self.loose:
            return self.loose[end]
        d = self.design.domain
        if d.association_of(end).name not in self.associations:
            return None
        return self.class_path(d.end(end).cls, either=True)

    def class_path(self, cls: str, either: bool = False) -> Path | None:
        """The identity of a class kept as itself or as a superclass; either: as a subclass too."""
        d = self.design.domain
        near = [*d.line(cls), *(sorted(d.below(cls)) if either else ())]
        return next((self.classes[c] for c in near if c in self.classes), None)

    def holds_superclass(self, cls: str) -> str | None:
        return next((c for c in self.design.domain.supers(cls) if c in self.classes), None)

    def structs(self) -> list[Struct]:
        return [self.design.structs[e] for e in self.design.sets[self.name].elements if e in self.design.structs]

    def grain(self) -> set[str]:
        """Root classes (or ends of anchor associations) that identify a row before any set is unnested."""
        return {k for s in self.structs()[:1] for k in anchor_keys(self.design, s)}

    def set_grain(self, path: Path) -> set[str]:
        """What an unnested set adds to the grain."""
        d, out = self.design, set()
        for e in d.sets[path[-1].name].elements:
            out |= anchor_keys(d, d.structs[e]) if e in d.structs else {d.domain.root(e)}
        return out

    @cached_property
    def schema(self) -> T.StructType:
        """The table's columns; sets are arrays of structs."""
        d = self.design.domain

        def build(prefix: Path) -> T.StructType:
            fields: dict[str, T.StructField] = {}
            for path, name in self.columns.items():
                if path[: len(prefix)] != prefix:
                    continue
                hop = path[len(prefix)]
                if hop.name in fields:
                    continue
                if hop.kind == "leaf":
                    size = None if d.is_end(name) else d.attribute(name).size
                    fields[hop.name] = T.StructField(name, d.type_of(name), True, {"size": size} if size else None)
                else:
                    inner = build((*prefix, hop))
                    fields[hop.name] = T.StructField(hop.name, T.ArrayType(inner, False) if hop.kind == "set" else inner)
            return T.StructType(list(fields.values()))

        return build(())


def anchor_keys(design: Design, struct: Struct) -> set[str]:
    """Root classes of a struct's anchor; an association counts as the root classes of its ends."""
    d, out = design.domain, set()
    for a in struct.anchor:
        out |= {d.root(e.cls) for e in d.associations[a].ends} if a in d.associations else {d.root(a)}
    return out


def present_classes(design: Design, struct: Struct) -> set[str]:
    """Classes of a struct and of the structs and sets in it."""
    out: set[str] = set()
    for e in struct.parts:
        if e in design.domain.classes:
            out.add(e)
        elif e in design.structs:
            out |= present_classes(design, design.structs[e])
        elif e in design.sets:
            for x in design.sets[e].elements:
                out |= present_classes(design, design.structs[x]) if x in design.structs else {x} & set(design.domain.classes)
    return out


def loose_ends(design: Design, struct: Struct) -> list[str]:
    """Ends whose class is not in the struct: they become columns, as a foreign key would."""
    d, here = design.domain, present_classes(design, struct)
    out = []
    for a in struct.parts:
        for end in d.associations[a].ends if a in d.associations else ():
            near = {*d.line(end.cls), *d.below(end.cls)}
            if not near & here:
                out.append(end.name)
    return out


def table_map(design: Design, name: str) -> TableMap:
    if name not in design.sets:
        raise ModelError(f"{name} is no set")
    cache = design.__dict__.setdefault("_maps", {})
    if name not in cache:
        cache[name] = TableMap(design, name)
    return cache[name]
