"""Logs, workloads, streams and the command line."""

import datetime
import json

import pytest
from library import books, catalog, machines, nested, plain, rows

from prismal import cli
from prismal.functions import workload
from prismal.operators import report
from prismal.operators.migrate import migrate
from prismal.operators.query import query
from prismal.plans import describe
from prismal.plans.paths import table_map
from prismal.sources import logs, specs, store
from prismal.streaming import inserts

PARSES = [
    ("SELECT TOP 10 p.objid, p.ra FROM dbo.PhotoObj AS p WHERE p.ra BETWEEN 1 AND 2 AND 3 < p.dec", {"pattern": ["photoobj"], "project": ["photoobj_objid", "photoobj_ra"], "filters": ["photoobj_dec >", "photoobj_ra between"], "top_value": 10}),
    ("select distinct a.x + b.y as z, count(*) from t1 a, t2 b where a.k = b.k and b.m >= 3 group by a.x order by 1", {"pattern": ["t1", "t2"], "project": ["count(*)", "t1_x", "t2_y"], "filters": ["t2_m >="], "has_distinct": True, "has_group_by": True, "has_order_by": True}),
    ("SELECT * FROM db..t WHERE name = 'a = b, c'", {"pattern": ["t"], "project": ["*"], "filters": ["t_name ="], "all_attributes": ["*"]}),
    ("SELECT s.z FROM fGetNearby(1, 2) n JOIN spec s ON n.id = s.id AND s.z > 0.1", {"pattern": ["spec"], "project": ["spec_z"], "filters": ["spec_z >"]}),
    ("SELECT g.type, [g].[class] FROM galaxy g", {"pattern": ["galaxy"], "project": ["galaxy_class", "galaxy_type"], "filters": []}),
]


@pytest.mark.parametrize("text,want", PARSES)
def test_parse(text, want):
    got = workload.parse(text)
    assert {k: got[k] for k in want} == want


def test_not_understood():
    assert workload.parse("SELECT 1") is None and workload.parse("SELECT a FROM f(1)") is None


def statements(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "statement string")


def test_rejects(spark):
    texts = ["SELECT a FROM t", "SELECT a FROM mydb.t", "SELECT a FROM t WHERE x IN (SELECT 1)", "update t", "x", None, "SELECT now()", "SELECT a INTO mydb.x FROM t", "select name from DBObjects"]
    good, bad = workload.parsed(statements(spark, texts))
    assert [r["statement"] for r in good.collect()] == ["SELECT a FROM t", "SELECT a INTO mydb.x FROM t"] or good.count() == 2
    assert sorted(r["reason"] for r in bad.collect()) == ["nested", "no select", "not understood", "private or metadata", "private or metadata", "too short", "too short"]


def test_merge_against_the_seed():
    shapes = [(("a", "b", "c", "d", "e"), ("a =",), 5), (("a", "b", "c", "d"), ("a =", "b >"), 3), (("a", "b", "c"), (), 2), (("x",), (), 1)]
    assert workload.merge_shapes(shapes, 1, 0.8) == [(["a", "b", "c", "d", "e"], ["a ="], 8), (["a", "b", "c"], [], 2)]
    assert workload.merge_shapes([(("*",), (), 4), (("a", "b"), (), 2)], 0, 0.8) == [(["*"], [], 6)]
    assert workload.parameterised(["a =", "b between", "c <"]) == "a = $1 AND b BETWEEN $2 AND $3 AND c < $4"


def test_groups(spark, tmp_path):
    texts = ["SELECT a, b FROM t WHERE c = 1"] * 6 + ["SELECT a, b, c FROM t"] * 2 + ["SELECT TOP 5 q FROM u"] * 2 + ["SELECT z FROM rare"]
    got = workload.grouped(workload.parsed(statements(spark, texts))[0], threshold=0.1).orderBy("group_id").collect()
    assert [(r["group_id"], r["pattern"], r["n"], r["filter"]) for r in got] == [(1, ["t"], 8, None), (2, ["u"], 2, None)]
    assert got[0]["frequency"] == pytest.approx(8 / 11) and got[0]["total"] == 11
    some = workload.grouped(workload.parsed(statements(spark, texts))[0], 0.1, modifiers=("top", "distinct"))
    assert json.loads(some.where("group_id = 2").first()["modifiers"]) == {"top_value": 5, "has_distinct": False}
    workload.save(some, str(tmp_path / "w.json"))
    assert [q.group_id for q in specs.queries(tmp_path / "w.json")] == [1, 2]
    with pytest.raises(ValueError):
        workload.grouped(workload.parsed(statements(spark, texts))[0], modifiers=("colour",))
    none = workload.grouped(workload.parsed(statements(spark, ["x"]))[0])
    assert none.count() == 0


def test_canonical():
    spec = workload.canonical(books(), ["book", "author", "other"], ["book_title", "author_name", "book_nothing"], "author_age > $1 AND B_title = 'author_age' AND book_b_id BETWEEN $2 AND $3")
    assert spec.pattern == ("Book", "Author", "Writes") and spec.filter == "B_title = 'author_age' AND B_ID BETWEEN $2 AND $3"
    assert workload.conditions("a = 1 AND (b = 2 AND c = 3) AND d BETWEEN 1 AND 2") == ["a = 1", "( b = 2 AND c = 3 )", "d BETWEEN 1 AND 2"] and workload.conditions("a = 1 OR b = 2") == ["a = 1 OR b = 2"]
    spec = workload.canonical(books(), ["BOOK"], ["b_title", "B_ID"], "b_id = $1")
    assert spec.project == ("B_title", "B_ID") and spec.filter == "B_ID = $1"
    assert workload.canonical(machines(), ["machine", "vehicle"], ["m_no"], None).pattern == ("Vehicle",)


def test_logs(spark, tmp_path):
    at = datetime.datetime(2025, 5, 2)
    log = spark.createDataFrame([(at, 0, 1.0, 5, "SELECT  a\n FROM t"), (at, 1, 1.0, 5, "b"), (at, 0, 0.0, 5, "c"), (datetime.datetime(2025, 6, 2), 0, 1.0, 1, "d")], "the_time timestamp, error int, elapsed double, rows long, statement string")
    assert logs.count(log).first()["total_logs"] == 2 and logs.count(log, 2025, 5, 2).first()["total_logs"] == 1
    assert [r[0] for r in logs.statements(log, month=5).collect()] == ["SELECT a FROM t"] and logs.statements(log, limit=1).count() == 1
    (tmp_path / "log.csv").write_text('statement,__EOL__\n"SELECT a  FROM t",__EOL__\nshort,__EOL__\n')
    assert [r[0] for r in logs.read_text(spark, str(tmp_path / "log.csv")).collect()] == ["SELECT a FROM t"]


def test_streamed_inserts(spark, tmp_path):
    kept = store.save(catalog(spark), f"{tmp_path}/c")
    spark.createDataFrame([(7, "seven"), (8, None)], "B_ID int, B_title string").write.parquet(f"{tmp_path}/in")
    rows_ = spark.readStream.schema("B_ID int, B_title string").parquet(f"{tmp_path}/in")
    q = inserts.insert_stream(kept, "books", rows_, f"{tmp_path}/check").start()
    q.processAllAvailable()
    q.stop()
    got = query(store.load(spark, f"{tmp_path}/c"), {"project": ["B_ID"], "pattern": ["Book"]})
    assert rows(got) == ["(1,)", "(2,)", "(3,)", "(7,)", "(8,)"]


def test_streamed_counts(spark, tmp_path):
    at = datetime.datetime(2025, 5, 2, 10, 5)
    spark.createDataFrame([(at, "SELECT a FROM t"), (at, "x"), (at, "SELECT a FROM mydb.t")], "the_time timestamp, statement string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("the_time timestamp, statement string").parquet(f"{tmp_path}/in")
    q = inserts.statement_counts(stream).writeStream.outputMode("complete").format("memory").queryName("statement_counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r["reason"]: r["n"] for r in spark.table("statement_counts").collect()} == {"counts": 1, "too short": 1, "private or metadata": 1}


def test_report(spark, tmp_path):
    made = catalog(spark)
    lines = report.run(made, [{"project": ["B_ID"], "pattern": ["Book"], "frequency": 0.75, "group_id": 1}, {"project": ["A_ID"], "pattern": ["Author"], "frequency": 0.25}], True, True, True, 2)
    assert [x.count for x in lines] == [3, 2] and len(lines[0].rows) == 2 and report.mean_cost(lines) > 0 and report.mean_seconds(lines) > 0
    report.write_csv(lines, tmp_path / "c.csv")
    assert (tmp_path / "c.csv").read_text().splitlines()[0] == "Order;Group ID;Weight;Cost;Time"


def test_describe():
    assert "Writes_Author -> Author 1..1" in describe.domain(books()) and "ByPower of Machine (disjoint, complete)" in describe.domain(machines())
    assert "topic_list:array" in describe.design(nested(books()))


def test_register(spark):
    store.register(migrate(catalog(spark), plain(books())), "library", buckets=2)
    try:
        assert spark.table("library.books").count() == 3
        assert "bucket" in " ".join(map(str, spark.sql("DESCRIBE EXTENDED library.books").collect())).lower()
    finally:
        spark.sql("DROP DATABASE library CASCADE")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "books.json").write_text(json.dumps(specs.domain_json(books())))
    for f in (plain, nested):
        (tmp_path / f"{f.__name__}.json").write_text(json.dumps(specs.design_json(f(books()))))
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"project": ["B_title", "T_name"], "pattern": ["Book", "Touches", "Topic"]}]}))
    (tmp_path / "i.json").write_text(json.dumps({"insertions": [{"data": {"B_ID": "5", "B_title": "'five'"}, "pattern": ["Book"]}, {"data": {"T_ID": "6", "T_name": "'six'"}, "pattern": ["Topic"]}, {"data": {"Touches_Topic": "6", "Touches_Book": "5"}, "pattern": ["Touches"]}, {"data": {"Writes_Author": "8", "Writes_Book": "5"}, "pattern": ["Writes"]}, {"data": {"A_ID": "8"}, "pattern": ["Author"]}]}))
    t = str(tmp_path)
    assert cli.main(["domain", f"{t}/books.json", "--show"]) == 0
    assert cli.main(["design", f"{t}/plain.json", "--create", f"{t}/a"]) == 0
    assert cli.main(["design", f"{t}/plain.json", "--create", f"{t}/a"]) == 1
    assert cli.main(["insert", f"{t}/a", f"{t}/i.json"]) == 0
    assert cli.main(["design", f"{t}/nested.json", "--show", "--create", f"{t}/b", "--source", f"{t}/a"]) == 0
    capsys.readouterr()
    for c in "ab":
        assert cli.main(["query", f"{t}/{c}", f"{t}/q.json", "--rows", "5", "--count", "--cost", "--csv", f"{t}/{c}.csv"]) == 0
        assert "five six" in capsys.readouterr().out
    assert table_map(nested(books()), "books").grain() == {"Book"}
    (tmp_path / "log.txt").write_text("statement\n" + "SELECT a FROM t\n" * 3)
    assert cli.main(["log", "group", f"{t}/log.txt", "--out", f"{t}/w.json"]) == 0
    assert json.loads((tmp_path / "w.json").read_text())["queries"][0]["pattern"] == ["t"]
