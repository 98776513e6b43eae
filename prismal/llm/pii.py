r"""Personal data spans, in DataFrame functions only.

Regular expressions propose spans, validators confirm them (part ranges, Luhn, ISO 7064 mod 97, digit counts) and words
near a span move its score. The four base kinds follow a fixed grammar and always count; an IBAN is confirmed by mod 97,
and a national number (ddd-dd-dddd) has no checksum, so that a context word must stand near it.

Positions come from split() and regexp_extract_all() with the same pattern: the gaps and the matches of a text alternate.
Each pattern is linear in the text: runs are possessive and a match may only start where a run starts or where the match
before ended (\G). They accept exactly what the plain patterns in the comments accept, leftmost first.

Cases: a null text is empty and has no spans; rows with a null id or repeated rows are scored each by itself; no rows give
no rows; other columns are ignored. Work is by row: no shuffle, so that no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The kinds' patterns.
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a kind to be looked for at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "national": r"[0-9]-[0-9]"}
#: Prior score of a confirmed span, and words that raise it if they stand within NEAR characters before it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "national": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|host|server|address)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|pay)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|bank|account|transfer)\b",
    "national": r"(?i)\b(?:ssn|social|security|national|id)\b",
}
NEAR, BOOST = 40, 0.3
#: A span of a kind with no validator of its own needs this score.
LEAST = {"national": 0.5}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks passes the mod 97 check: its first four characters go last, letters count from 10."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + (c - 55)) % 97).otherwise((acc * 10 + (c - 48)) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: str, x: Column) -> Column:
    """The validator of a kind, for a match."""
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]|[1-9]|)"  # zeros alone are 0
        return x.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        d = _digits(x)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    if kind == "iban":
        bare = F.replace(x, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(F.lit(False))
    return F.lit(True)


def _found(kind: str) -> Column:
    """Spans of a kind as structs of kind, start, end (code points), found and lead (what stands just before)."""
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<rank:int,start:int,end:int,kind:string,found:string,lead:string>>)").alias("spans"))
    rank = list(PATTERNS).index(kind)
    pairs = F.arrays_zip(F.col(f"gaps_{kind}").alias("gap"), F.col(f"hits_{kind}").alias("hit"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        span = F.struct(F.lit(rank).alias("rank"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), p["hit"].alias("found"), F.right(p["gap"], F.lit(NEAR)).alias("lead"))
        return F.struct(end.cast("int").alias("at"), F.when(p["hit"].isNotNull() & confirmed(kind, p["hit"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pairs, empty, step)["spans"]


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: an array of (rank, start, end, kind, found, lead, score), by start, then kind as listed."""
    rows = docs.select("doc_id", text_of().alias("text"))
    no = F.expr("cast(array() as array<string>)")
    rows = rows.select(
        "doc_id",
        *[F.when(F.col("text").rlike(NEEDS[k]), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(no).alias(f"hits_{k}") for k in PATTERNS],
        "text",
    )
    rows = rows.select("doc_id", *[f"hits_{k}" for k in PATTERNS], *[F.when(F.size(f"hits_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(no).alias(f"gaps_{k}") for k in PATTERNS])
    spans = F.concat(*[_found(k) for k in PATTERNS])

    def scored(s: Column) -> Column:
        near, prior, least = F.lit(False), F.lit(0.0), F.lit(0.0)
        for k in PATTERNS:
            near = F.when(s["kind"] == k, s["lead"].rlike(CONTEXT[k])).otherwise(near)
            prior = F.when(s["kind"] == k, F.lit(PRIOR[k])).otherwise(prior)
            least = F.when(s["kind"] == k, F.lit(LEAST.get(k, 0.0))).otherwise(least)
        score = F.least(F.lit(1.0), prior + F.when(near, F.lit(BOOST)).otherwise(F.lit(0.0)))
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("found"), score.alias("score"), (score >= least).alias("sure"))

    any_hit = F.greatest(*[F.size(f"hits_{k}") for k in PATTERNS]) > 0
    kind = "array<struct<start:int,rank:int,end:int,kind:string,found:string,score:double,sure:boolean>>"
    made = F.filter(F.transform(spans, scored), lambda s: s["sure"])
    return rows.select("doc_id", F.array_sort(F.when(any_hit, made).otherwise(F.expr(f"cast(array() as {kind})"))).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(docs: DataFrame) -> DataFrame:
    found = find_spans(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
