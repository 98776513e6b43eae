"""Workloads from logged SQL: which statements count, what they read, and the groups that they fall into.

Statements are filtered with Spark functions, taken apart by a small scanner in pandas batches, and grouped by the set of
their tables. In a group, shapes (sets of columns) are counted before any of them meets another, so that a task sees a row
for each distinct shape and not for each statement. Merging shapes is greedy and depends on their order, which is fixed:
shapes with a star first, then more columns, then by name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Domain, QuerySpec

# Statements with one of these are left out.
DISCARD = (
    r"from\s+mydb\.", r"join\s+mydb\.", r"update\s+mydb\.", r"delete\s+from\s+mydb\.",
    r"\bdbobjects\b", r"\bsqllog\b", r"\bdbcolumns\b", r"\binformation_schema\b", r"\bexec\b", r"\bcreate\s+table\b",
)
LEAST_LENGTH, THRESHOLD, JACCARD, DAYS = 6, 0.005, 0.8, 30
MODIFIERS = ("distinct", "groupby", "orderby", "top")

_TOKEN = re.compile(r"'(?:[^']|'')*'|\[[^\]]*\]|\"[^\"]*\"|\d+\.?\d*(?:[eE][+-]?\d+)?|[A-Za-z_#@][\w#@$]*|<>|!=|>=|<=|\|\||[^\s]")
_CLAUSE = frozenset("select from where group order having into union on join inner left right full outer cross and or as by".split())
_OPS = frozenset("= < > <= >= <> != like".split())
_WORDS = frozenset("and or not in is null like between as on case when then else end asc desc distinct top cast".split())


def reason_of(s: Column) -> Column:
    """Null if a statement counts, else why not."""
    selects = F.size(F.regexp_extract_all(s, F.lit(r"(?i)\b(select)\b"), F.lit(1)))
    return (
        F.when(s.isNull() | (F.length(F.trim(s)) <= LEAST_LENGTH), "too short")
        .when(selects == 0, "no select")
        .when(selects > 1, "nested")
        .when(s.rlike("(?i)(" + "|".join(DISCARD) + ")"), "private or metadata")
    )


def classified(statements: DataFrame) -> DataFrame:
    """statement with reason: null if it counts, else why not."""
    return statements.select("statement", reason_of(F.col("statement")).alias("reason"))


def _name(token: str) -> str:
    return token.strip('[]"').lower()


def _is_name(token: str) -> bool:
    return bool(re.match(r"[A-Za-z_#@\[\"]", token)) and token.lower() not in _CLAUSE | _WORDS


def _split(tokens: list[str], by: str) -> list[list[str]]:
    """Parts between a separator outside of brackets."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if depth == 0 and t.lower() == by:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _clauses(tokens: list[str]) -> dict[str, list[str]]:
    """Tokens of each clause; joins belong to from, their conditions to on."""
    out: dict[str, list[str]] = {}
    at, depth = "", 0
    for i, t in enumerate(tokens):
        low = t.lower()
        depth += (t == "(") - (t == ")")
        if depth == 0 and low in ("select", "from", "where", "having", "into") or depth == 0 and low in ("group", "order") and tokens[i + 1 : i + 2] and tokens[i + 1].lower() == "by":
            at = low
            out.setdefault(at, [])
        elif depth == 0 and low == "on" and at in ("from", "on"):
            at = "on"
            out.setdefault(at, []).append("and")
        elif depth == 0 and low in ("join", "inner", "left", "right", "full", "cross", "outer") and at in ("from", "on"):
            at = "from"
            out["from"].append("," if low == "join" else "")
        elif depth == 0 and at == "on" and t == ",":
            at = "from"
            out["from"].append(",")
        else:
            out.setdefault(at, []).append(t)
    return out


def _columns(tokens: list[str], aliases: dict[str, str], tables: list[str]) -> list[str]:
    """Columns in an expression as table_column; those of unknown tables and calls of functions are left out."""
    out, i = [], 0
    while i < len(tokens):
        if not _is_name(tokens[i]):
            i += 1
            continue
        parts, j = [_name(tokens[i])], i + 1
        while j + 1 < len(tokens) and tokens[j] == "." and (_is_name(tokens[j + 1]) or tokens[j + 1] == "*" or tokens[j + 1].lower() in _CLAUSE | _WORDS):
            parts.append(_name(tokens[j + 1]))
            j += 2
        if j < len(tokens) and tokens[j] == "(":
            i = j
            continue
        i = j
        if len(parts) > 1:
            table = aliases.get(parts[-2])
            if table:
                out.append("*" if parts[-1] == "*" else f"{table}_{parts[-1]}")
        elif len(tables) == 1:
            out.append(f"{tables[0]}_{parts[0]}")
        else:
            out.append(parts[0])
    return out


def parse(statement: str) -> dict | None:
    """Tables, projected columns, filters and flags of a select statement; None if it can't be taken apart."""
    top = re.search(r"\btop\s+\(?(\d+)\)?", statement, re.I)
    distinct = bool(re.search(r"\bdistinct\b", statement, re.I))
    plain = re.sub(r"\btop\s+\(?\d+\)?|\bdistinct\b", " ", statement, flags=re.I)
    clauses = _clauses(_TOKEN.findall(plain.rstrip("; ")))
    if not clauses.get("from") or not clauses.get("select"):
        return None
    tables, aliases = [], {}
    for part in _split([t for t in clauses["from"] if t], ","):
        if not part or not _is_name(part[0]):
            continue
        j = 1
        while j < len(part) and part[j] == ".":
            while j < len(part) and part[j] == ".":
                j += 1
            j += 1
        if j < len(part) and part[j] == "(":  # a function as a table
            depth, k = 0, j
            while k < len(part):
                depth += (part[k] == "(") - (part[k] == ")")
                k += 1
                if not depth:
                    break
            continue
        table = _name(part[j - 1])
        rest = [t for t in part[j:] if t.lower() != "as"]
        tables.append(table)
        aliases[table] = table
        if rest and _is_name(rest[0]):
            aliases[_name(rest[0])] = table
    tables = list(dict.fromkeys(tables))
    if not tables:
        return None
    project: list[str] = []
    for item in _split(clauses["select"], ","):
        if "href=http" in "".join(item).lower():  # a link made in the select list
            continue
        if item == ["*"] or item[-2:] == [".", "*"]:
            project = ["*"]
            break
        flat = "".join(item).lower().replace(" ", "")
        if flat.startswith("count("):
            project.append("count(*)")
            continue
        cut = [i for i, t in enumerate(item) if t.lower() == "as"]
        body = item[: cut[-1]] if cut else item[:-1] if len(item) > 1 and _is_name(item[-1]) and item[-2] not in (".", "+", "-", "*", "/", "(") and _is_name(item[-2]) else item
        project += _columns(body, aliases, tables)
    filters = set()
    for clause in ("where", "on"):
        tokens = clauses.get(clause, [])
        i = 0
        while i < len(tokens):
            if tokens[i].lower() in _OPS or tokens[i].lower() == "between":
                left, right = _side(tokens, i, -1), _side(tokens, i, 1)
                a, b = _columns(left, aliases, tables), _columns(right, aliases, tables)
                if tokens[i].lower() == "between":
                    filters |= {f"{x} between" for x in a[:1]}
                elif len(a) == 1 and not _has_names(right):
                    filters.add(f"{a[0]} {tokens[i].lower()}")
                elif len(b) == 1 and not _has_names(left):
                    filters.add(f"{b[0]} {_turned(tokens[i].lower())}")
            i += 1
    project = ["*"] if "*" in project else list(dict.fromkeys(project))
    used = sorted({f.rsplit(" ", 1)[0] for f in filters})
    return {
        "pattern": sorted(tables),
        "project": sorted(project),
        "filters": sorted(filters),
        "all_attributes": ["*"] if project == ["*"] else sorted({*project, *used}),
        "has_distinct": distinct,
        "has_group_by": "group" in clauses,
        "has_order_by": "order" in clauses,
        "top_value": int(top[1]) if top else None,
    }


def _has_names(tokens: list[str]) -> bool:
    return any(_is_name(t) and tokens[i + 1 : i + 2] != ["("] for i, t in enumerate(tokens))


def _turned(op: str) -> str:
    return {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)


def _side(tokens: list[str], at: int, step: int) -> list[str]:
    out, i, depth = [], at + step, 0
    while 0 <= i < len(tokens):
        t = tokens[i]
        depth += ((t == "(") - (t == ")")) * step
        if depth < 0 or depth == 0 and (t.lower() in ("and", "or", "between", "not") or t.lower() in _OPS):
            break
        out.append(t)
        i += step
    return out[::step]


PARSED = "statement string, pattern array<string>, project array<string>, filters array<string>, all_attributes array<string>, has_distinct boolean, has_group_by boolean, has_order_by boolean, top_value int, ok boolean"


def parsed(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each statement that counts reads; and the others with the reason."""
    marked = classified(statements)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PARSED.split(", ")]
        for batch in batches:
            found = [(s, parse(s)) for s in batch["statement"]]
            out = pd.DataFrame([{"statement": s, **(p or {}), "ok": p is not None} for s, p in found], columns=names)
            out["top_value"] = out["top_value"].astype("Int32")
            yield out.astype(object).where(out.notna(), None)

    each = marked.where("reason is null").select("statement").mapInPandas(run, PARSED)
    rejects = marked.where("reason is not null").unionByName(each.where("not ok").select("statement", F.lit("not understood").alias("reason")))
    return each.where("ok").drop("ok"), rejects


GROUP = "pattern array<string>, modifiers string, project array<string>, filter string, n long"


def merge_shapes(shapes: list[tuple[tuple[str, ...], tuple[str, ...], int]], least: float, jaccard: float = JACCARD) -> list[tuple[list[str], list[str], int]]:
    """Greedy merge of (columns, conditions, count): each seed takes in what is similar to itself; groups over least stay."""
    union = {c for cols, _, _ in shapes for c in cols if c != "*"}
    order = sorted(shapes, key=lambda s: ("*" not in s[0], -len(s[0]), s[0]))
    wide = {s: union if "*" in s[0] else set(s[0]) for s in order}
    out, taken = [], set()
    for i, seed in enumerate(order):
        if i in taken:
            continue
        columns, conditions, total = set(seed[0]), set(seed[1]), seed[2]
        for j in range(i + 1, len(order)):
            other = order[j]
            if j in taken:
                continue
            both, either = wide[seed] & wide[other], wide[seed] | wide[other]
            if (len(both) / len(either) if either else 1.0) >= jaccard:
                taken.add(j)
                columns |= set(other[0])
                conditions &= set(other[1])
                total += other[2]
        if total > least:
            out.append((["*"] if "*" in columns else sorted(columns), sorted(conditions), total))
    return out


def parameterised(conditions: list[str]) -> str | None:
    """a = $1 AND b BETWEEN $2 AND $3 ..."""
    out, n = [], 1
    for c in conditions:
        column, op = c.rsplit(" ", 1)
        if op == "between":
            out.append(f"{column} BETWEEN ${n} AND ${n + 1}")
            n += 2
        else:
            out.append(f"{column} {op} ${n}")
            n += 1
    return " AND ".join(out) or None


def grouped(queries: DataFrame, threshold: float = THRESHOLD, jaccard: float = JACCARD, modifiers: tuple[str, ...] = ()) -> DataFrame:
    """group_id (by falling frequency), pattern, modifiers, project, filter, n, frequency, total, per_second of the frequent groups.

    A task merges the distinct shapes of one set of tables, which are as many as there are ways to ask them and not statements;
    merging takes time by their square. Groups are 1 / threshold at most, and with a threshold of 0 as many as shapes.
    """
    columns = {"distinct": "has_distinct", "groupby": "has_group_by", "orderby": "has_order_by", "top": "top_value"}
    unknown = set(modifiers) - set(columns)
    if unknown:
        raise ValueError(f"no such modifiers: {sorted(unknown)}")
    key = F.array_sort(F.array_distinct(F.transform("pattern", lambda t: F.lower(F.split(t, " ")[0]))))
    kind = F.to_json(F.struct(*[F.col(columns[m]) for m in modifiers])) if modifiers else F.lit("{}")
    q = queries.select(key.alias("pattern"), kind.alias("modifiers"), F.array_sort("all_attributes").alias("columns"), "filters")
    every = q.groupBy("pattern", "modifiers", "columns", "filters").agg(F.count(F.lit(1)).alias("n")).persist()  # a row for each shape: statements are taken apart once
    total = every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = total * threshold
    often = every.groupBy("pattern", "modifiers").agg(F.sum("n").alias("group_n")).where(F.col("group_n") > least)
    shapes = every.join(often, ["pattern", "modifiers"], "left_semi")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        by: dict[tuple[str, ...], tuple[set[str], int]] = {}
        for cols, conditions, n in zip(group["columns"], group["filters"], group["n"], strict=True):
            known, so_far = by.get(tuple(cols), (set(conditions), 0))
            by[tuple(cols)] = (known & set(conditions), so_far + int(n))
        found = merge_shapes([(c, tuple(sorted(f)), n) for c, (f, n) in by.items()], least, jaccard)
        first = group.iloc[0]
        return pd.DataFrame([(list(first["pattern"]), first["modifiers"], p, parameterised(f), n) for p, f, n in found], columns=[x.split()[0] for x in GROUP.split(", ")])

    groups = shapes.withColumn("key", F.concat_ws(",", "pattern")).groupBy("key", "modifiers").applyInPandas(merge, GROUP)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "pattern", "modifiers", "project"))  # only groups, of which there are few
    return groups.select(
        rank.alias("group_id"), "pattern", "modifiers", "project", "filter", "n", (F.col("n") / F.lit(max(1, total))).alias("frequency"),
        F.lit(total).cast("long").alias("total"), F.lit(total / (DAYS * 24 * 3600)).alias("per_second"),
    )


def conditions(text: str) -> list[str]:
    """The parts of a filter that AND joins, outside of strings, brackets and BETWEEN; all of it if OR joins them."""
    out, depth, between = [[]], 0, False
    for t in re.findall(r"'[^']*'|[()]|[^\s()']+", text):
        depth += (t == "(") - (t == ")")
        low = t.lower()
        if depth == 0 and low == "or":
            return [text]
        if depth == 0 and low == "and" and not between:
            out.append([])
            continue
        between = depth == 0 and (low == "between" or between and low != "and")
        out[-1].append(t)
    return [" ".join(x) for x in out if x]


def canonical(domain: Domain, pattern: list[str], project: list[str], filter_text: str | None, classes: dict[str, str] | None = None) -> QuerySpec:
    """A group as a query over a domain: tables become classes, associations between them are added, superclasses of others go.

    classes: class by logged table name, where it is not the name itself; columns of a table go to the class of its line that has them.
    What names no attribute or end is left out, of the projection and of the filter's conditions; $n keep their numbers.
    """
    by_low = {c.lower(): c for c in domain.classes}
    found = [(classes or {}).get(t, by_low.get(t.lower())) for t in pattern]
    known = list(dict.fromkeys(c for c in found if c))
    kept = [c for c in known if not any(c in domain.supers(o) for o in known)]
    roots = {domain.root(c) for c in kept}
    links = [a.name for a in domain.associations.values() if len(roots) > 1 and {domain.root(e.cls) for e in a.ends} <= roots and len({domain.root(e.cls) for e in a.ends}) > 1]
    low = {n.lower(): n for n in domain.names if domain.is_attribute(n) or domain.is_end(n)}
    rename: dict[str, str] = {}
    for t, c in zip(pattern, found, strict=True):
        for x in domain.line(c) if c else ():
            for a in domain.own_attributes(x):
                rename.setdefault(f"{t.lower()}_{a.lower().removeprefix(x.lower() + '_')}", a)

    def name(column: str) -> str | None:
        return low.get(column.lower()) or rename.get(column.lower())

    columns = ["*"] if "*" in project else list(dict.fromkeys(n for c in project if (n := name(c))))
    kept_conditions = []
    for text in conditions(filter_text or ""):
        words = [w for w in re.findall(r"'[^']*'|[A-Za-z_]\w*", text) if w[0] != "'" and w.lower() not in _WORDS]
        if all(map(name, words)):
            kept_conditions.append(re.sub(r"'[^']*'|[A-Za-z_]\w*", lambda m: m[0] if m[0][0] == "'" else name(m[0]) or m[0], text))
    filter_text = " AND ".join(kept_conditions) or None
    return QuerySpec(tuple(columns), tuple([*kept, *links]), filter_text)


def save(groups: DataFrame, path: str) -> None:
    """The groups as a query file; they are few."""
    rows = [r.asDict() for r in groups.orderBy("group_id").collect()]
    out = {"total_queries": rows[0]["total"] if rows else 0, "queries_per_second": rows[0]["per_second"] if rows else 0.0, "queries": [{k: r[k] for k in ("group_id", "frequency", "pattern", "project", "filter")} for r in rows]}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=1)
