"""Domains (classes, associations, generalizations) and designs (structs and sets over them)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import types as T

# Names of domain types and what they are in Spark.
TYPES = {
    "integer": T.IntegerType(), "int": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(),
    "double precision": T.DoubleType(), "string": T.StringType(), "char": T.StringType(), "varchar": T.StringType(), "text": T.StringType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
}


class ModelError(ValueError):
    """A domain, design, query or insert that can't be right."""


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "String"
    size: int | None = None
    distinct: int | None = None
    identifier: bool = False

    @property
    def spark_type(self) -> T.DataType:
        found = TYPES.get(self.type.lower())
        if found is None:
            raise ModelError(f"{self.name}: no such type: {self.type}")
        return found


@dataclass(frozen=True)
class ClassDef:
    name: str
    attributes: tuple[Attribute, ...] = ()
    count: int | None = None


@dataclass(frozen=True)
class End:
    name: str
    cls: str
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Association:
    name: str
    ends: tuple[End, ...]


@dataclass(frozen=True)
class Subclass:
    cls: str
    constraint: str | None = None


@dataclass(frozen=True)
class Generalization:
    name: str
    superclass: str
    subclasses: tuple[Subclass, ...]
    disjoint: bool | None = None
    complete: bool | None = None


@dataclass(frozen=True)
class Guard:
    """An insert that every design of the domain must allow."""

    pattern: tuple[str, ...]
    data: tuple[str, ...]


@dataclass
class Domain:
    name: str = "domain"
    classes: dict[str, ClassDef] = field(default_factory=dict)
    associations: dict[str, Association] = field(default_factory=dict)
    generalizations: dict[str, Generalization] = field(default_factory=dict)
    guards: list[Guard] = field(default_factory=list)

    def _new(self, *names: str) -> None:
        taken = self.names
        for i, x in enumerate(names):
            if x in taken or x in names[:i]:
                raise ModelError(f"the name {x} is taken")
        self.__dict__.pop("names", None)
        self.__dict__.pop("_owners", None)
        self.__dict__.pop("_ends", None)

    def add_class(self, name: str, *attributes: Attribute, count: int | None = None) -> None:
        self._new(name, *[a.name for a in attributes])
        self.classes[name] = ClassDef(name, attributes, count)

    def add_association(self, name: str, *ends: End) -> None:
        if len(ends) != 2:
            raise ModelError(f"{name}: an association has two ends")
        self._new(name, *[e.name for e in ends])
        for e in ends:
            if e.cls not in self.classes:
                raise ModelError(f"{name}: no class {e.cls}")
        self.associations[name] = Association(name, ends)

    def add_generalization(self, name: str, superclass: str, *subclasses: Subclass, disjoint: bool = True, complete: bool = True) -> None:
        self._new(name)
        for c in (superclass, *[s.cls for s in subclasses]):
            if c not in self.classes:
                raise ModelError(f"{name}: no class {c}")
        for s in subclasses:
            if any(g.superclass != superclass and s.cls in {x.cls for x in g.subclasses} for g in self.generalizations.values()):
                raise ModelError(f"{name}: {s.cls} has a superclass")
        self.generalizations[name] = Generalization(name, superclass, subclasses, disjoint, complete)

    @cached_property
    def names(self) -> frozenset[str]:
        out = {*self.classes, *self.associations, *self.generalizations}
        out |= {a.name for c in self.classes.values() for a in c.attributes}
        return frozenset(out | {e.name for x in self.associations.values() for e in x.ends})

    @cached_property
    def _owners(self) -> dict[str, tuple[str, Attribute]]:
        return {a.name: (c.name, a) for c in reversed(self.classes.values()) for a in c.attributes}

    @cached_property
    def _ends(self) -> dict[str, tuple[Association, End]]:
        return {e.name: (x, e) for x in self.associations.values() for e in x.ends}

    def is_attribute(self, name: str) -> bool:
        return name in self._owners

    def is_end(self, name: str) -> bool:
        return name in self._ends

    def owner(self, attribute: str) -> str:
        return self._owners[attribute][0]

    def attribute(self, name: str) -> Attribute:
        return self._owners[name][1]

    def end(self, name: str) -> End:
        return self._ends[name][1]

    def association_of(self, end: str) -> Association:
        return self._ends[end][0]

    def parent(self, cls: str) -> str | None:
        return next((g.superclass for g in self.generalizations.values() for s in g.subclasses if s.cls == cls), None)

    def supers(self, cls: str) -> list[str]:
        """Superclasses from the nearest up."""
        out: list[str] = []
        while (cls := self.parent(cls) or "") and cls not in out:
            out.append(cls)
        return out

    def line(self, cls: str) -> list[str]:
        return [cls, *self.supers(cls)]

    def root(self, cls: str) -> str:
        return self.line(cls)[-1]

    def children(self, cls: str) -> list[str]:
        return [s.cls for g in self.generalizations.values() if g.superclass == cls for s in g.subclasses]

    def below(self, cls: str) -> set[str]:
        out, todo = set(), self.children(cls)
        while todo:
            c = todo.pop()
            if c not in out:
                out.add(c)
                todo += self.children(c)
        return out

    def generalizations_of(self, cls: str) -> list[Generalization]:
        return [g for g in self.generalizations.values() if g.superclass == cls]

    def constraint(self, cls: str) -> str | None:
        return next((s.constraint for g in self.generalizations.values() for s in g.subclasses if s.cls == cls), None)

    def identifier(self, cls: str) -> str:
        for c in reversed(self.line(cls)):
            for a in self.classes[c].attributes:
                if a.identifier:
                    return a.name
        raise ModelError(f"{cls} has no identifier")

    def own_attributes(self, cls: str, inherited: bool = True) -> list[str]:
        line = reversed(self.line(cls)) if inherited else [cls]
        return [a.name for c in line for a in self.classes[c].attributes]

    def type_of(self, name: str) -> T.DataType:
        return self.attribute(self.identifier(self.end(name).cls) if self.is_end(name) else name).spark_type


@dataclass(frozen=True)
class Struct:
    name: str
    anchor: tuple[str, ...]
    elements: tuple[str, ...]

    @property
    def parts(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.anchor, *self.elements)))


@dataclass(frozen=True)
class SetDef:
    name: str
    elements: tuple[str, ...]


FLAT, NESTED = "1NF", "NF2"


@dataclass
class Design:
    domain: Domain
    name: str = "design"
    paradigm: str = FLAT
    structs: dict[str, Struct] = field(default_factory=dict)
    sets: dict[str, SetDef] = field(default_factory=dict)

    def _new(self, name: str, elements: tuple[str, ...]) -> None:
        if name in self.domain.names or name in self.structs or name in self.sets:
            raise ModelError(f"the name {name} is taken")
        for e in elements:
            if not (e in self.structs or e in self.sets or e in self.domain.names):
                raise ModelError(f"{name}: no element {e}")

    def add_struct(self, name: str, anchor: tuple[str, ...] | list[str], elements: tuple[str, ...] | list[str] = ()) -> None:
        anchor, elements = tuple(anchor), tuple(elements)
        self._new(name, (*anchor, *elements))
        if not anchor:
            raise ModelError(f"{name}: a struct has an anchor")
        for a in anchor:
            if a not in self.domain.classes and a not in self.domain.associations:
                raise ModelError(f"{name}: the anchor {a} is no class or association")
        self.structs[name] = Struct(name, anchor, elements)

    def add_set(self, name: str, *elements: str) -> None:
        self._new(name, elements)
        for e in elements:
            if e not in self.structs and e not in self.domain.classes:
                raise ModelError(f"{name}: a set holds structs or a class, not {e}")
        self.sets[name] = SetDef(name, elements)

    def containers(self, name: str) -> list[str]:
        return [x.name for x in (*self.structs.values(), *self.sets.values()) if name in (x.parts if isinstance(x, Struct) else x.elements)]

    def first_level(self) -> list[str]:
        """The tables: what nothing else contains."""
        return [x for x in (*self.sets, *self.structs) if not self.containers(x)]

    def tables(self) -> list[str]:
        return [x for x in self.first_level() if x in self.sets]


@dataclass(frozen=True)
class QuerySpec:
    project: tuple[str, ...]
    pattern: tuple[str, ...]
    filter: str | None = None
    frequency: float = 1.0
    group_id: int | None = None

    @classmethod
    def of(cls, given: dict | QuerySpec) -> QuerySpec:
        if isinstance(given, QuerySpec):
            return given
        return cls(tuple(given.get("project", ())), tuple(given.get("pattern", ())), given.get("filter") or None, float(given.get("frequency", 1.0)), given.get("group_id"))


@dataclass(frozen=True)
class InsertSpec:
    data: dict[str, str]
    pattern: tuple[str, ...]

    @classmethod
    def of(cls, given: dict | InsertSpec) -> InsertSpec:
        return given if isinstance(given, InsertSpec) else cls(dict(given["data"]), tuple(given["pattern"]))
