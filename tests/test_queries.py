import pytest
from library import DESIGNS, all_in_one, books, catalog, foreign_key, machines, nested, per_subclass, plain, rows, split, table_per_class, yard_catalog

from prismal.model import ModelError
from prismal.operators.migrate import migrate
from prismal.operators.query import costs, query, rewritings

SPECS = [
    (["B_title", "A_age"], ["Writes", "Book", "Author"], "B_ID <= 2 OR A_age IS NOT NULL"),
    (["T_name", "A_name"], ["Topic", "Touches", "Book", "Writes", "Author"], "A_age > 20 AND T_name <> 'sky'"),
    (["T_name", "A_ID"], ["Topic", "Touches", "Book", "Writes", "Author"], "T_ID = 21 OR A_age BETWEEN 20 AND 29"),
    (["Touches_Book"], ["Touches"], "Touches_Topic = 21"),
    (["Touches_Topic", "B_title"], ["Touches", "Book"], None),
    (["*"], ["Author"], "A_age IS NULL"),
    (["Topic_*", "B_ID"], ["Topic", "Touches", "Book"], "B_ID > 0"),
    (["B_ID", "Author_*"], ["Book", "Writes", "Author"], "(A_age IS NULL) OR B_ID IN (1, 2)"),
    (["T_ID"], ["Topic"], "T_name LIKE 's%'"),
    (["B_title", "B_ID"], ["Book"], "NOT (B_title = 'two')"),
]


@pytest.mark.parametrize("design", DESIGNS[1:], ids=lambda f: f.__name__)
def test_designs_answer_alike(spark, design):
    source = catalog(spark)
    target = migrate(source, design(source.design.domain))
    for project, pattern, text in SPECS:
        spec = {"project": project, "pattern": pattern, "filter": text}
        assert rows(query(target, spec)) == rows(query(source, spec)), spec


@pytest.mark.parametrize("design", DESIGNS[1:], ids=lambda f: f.__name__)
def test_there_and_back(spark, design):
    source = catalog(spark)
    back = migrate(migrate(source, design(source.design.domain)), plain(source.design.domain))
    for t in source.tables:
        assert rows(back.table(t)) == rows(source.table(t).select(*back.table(t).columns)), t


def test_minimal_covers(spark):
    d = books()
    spec = {"project": ["B_title", "A_name"], "pattern": ["Author", "Book", "Writes"], "filter": "A_age > 1"}
    source = catalog(spark)
    assert [sorted(r.names) for r in rewritings(source, spec)] == [["authors", "books", "writes"]]
    assert [sorted(r.names) for r in rewritings(migrate(source, foreign_key(d)), spec)] == [["authors", "books"]]
    assert [r.names for r in rewritings(migrate(source, nested(d)), spec)] == [["books"]]
    found = rewritings(migrate(source, split(d)), {"project": ["A_ID"], "pattern": ["Author"]})
    assert len(found) == 2


def test_childless_rows_stay(spark):
    source = catalog(spark)
    got = migrate(source, nested(source.design.domain)).table("books").select("B_ID", "topic_list").collect()
    assert {r["B_ID"]: len(r["topic_list"]) for r in got} == {1: 2, 2: 1, 3: 0}


HIERARCHY = [
    (["M_no", "M_yard"], ["Machine"]),
    (["H_battery", "M_yard"], ["Handheld"]),
    (["M_power", "V_plate"], ["Vehicle"]),
    (["V_plate", "C_lead"], ["Vehicle", "Mans", "Crew"]),
    (["tower", "towed"], ["Tows"]),
    (["M_yard", "tower"], ["Machine", "Tows"]),
]


@pytest.mark.parametrize("design", [all_in_one, per_subclass], ids=lambda f: f.__name__)
def test_hierarchies(spark, design):
    source = yard_catalog(spark)
    target = migrate(source, design(source.design.domain))
    for project, pattern in HIERARCHY:
        spec = {"project": project, "pattern": pattern}
        assert rows(query(target, spec)) == rows(query(source, spec)), spec


def test_subclass_discriminant(spark):
    source = yard_catalog(spark)
    assert rows(query(source, {"project": ["M_no", "M_yard"], "pattern": ["Vehicle"]})) == ["(8, 'south')", "(9, 'north')"]
    assert rows(query(migrate(source, all_in_one(machines())), {"project": ["M_no"], "pattern": ["Handheld"]})) == ["(10,)", "(7,)"]


def test_disjoint_siblings_have_no_common_rows(spark):
    assert rows(query(yard_catalog(spark), {"project": ["M_no", "V_plate", "H_battery"], "pattern": ["Vehicle", "Handheld"]})) == []


def test_parameters(spark):
    source, spec = catalog(spark), {"project": ["B_ID"], "pattern": ["Book"], "filter": "B_title = $1 OR B_ID = $2"}
    assert rows(query(source, spec, values=["one", 3])) == ["(1,)", "(3,)"]
    assert rows(query(source, {**spec, "filter": "B_title = $1"}, values=["o'ne\\"])) == []
    with pytest.raises(ModelError):
        query(source, spec)
    assert costs(source, spec)[0][1] > 0


def test_repetitions_and_wildcards(spark):
    from library import one_table

    made = migrate(catalog(spark), one_table(books()))
    spec = {"project": ["A_name"], "pattern": ["Author"]}
    assert rows(query(made, spec)) == ["('ann',)", "('bob',)"]
    assert rows(query(made, spec, dedupe=False)) == ["('ann',)", "('ann',)", "('bob',)"]
    source = yard_catalog(spark)
    assert query(source, {"project": ["Handheld_*"], "pattern": ["Handheld"]}).columns == ["M_no", "M_power", "M_yard", "H_battery"]
    assert query(source, {"project": ["*"], "pattern": ["Handheld"]}, inherited=False).columns == ["H_battery"]


def test_string_equal_to_a_name_is_not_a_name(spark):
    assert rows(query(catalog(spark), {"project": ["B_ID"], "pattern": ["Book"], "filter": "B_title = 'B_ID'"})) == []


@pytest.mark.parametrize(
    "spec",
    [
        {"project": ["B_ID"], "pattern": []},
        {"project": [], "pattern": ["Book"]},
        {"project": ["B_ID"], "pattern": ["Nothing"]},
        {"project": ["nothing"], "pattern": ["Book"]},
        {"project": ["B_ID", "T_ID"], "pattern": ["Book", "Topic"]},
        {"project": ["A_name"], "pattern": ["Book"]},
        {"project": ["B_ID"], "pattern": ["Book"], "filter": "B_ID = = 1"},
    ],
)
def test_bad_queries(spark, spec):
    with pytest.raises(ModelError):
        query(catalog(spark), spec)


def test_least_cost_is_chosen(spark):
    made = migrate(catalog(spark), split(books()))
    assert rows(query(made, {"project": ["A_ID"], "pattern": ["Author"]}, choose="cost")) == ["(11,)", "(12,)"]


def test_other_domain_is_refused(spark):
    with pytest.raises(ModelError):
        migrate(catalog(spark), table_per_class(machines()))


def test_pushdown(spark, sf):
    from prismal import queries

    plan = queries.queries()["q_customer_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "c_acctbal" not in plan.split("ReadSchema")[1]
