"""Decontamination finds whole items: in other case, with many slots in a row, in amounts, under shared ids, and short ones."""

import odd
import pytest
from test_fuzzy import prose

from prismal.llm import decontam


def found(spark, items, rows):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: r for r in decontam.op8_decontamination(odd.docs(spark, rows), bench).collect()}


@pytest.mark.parametrize("form", [str.upper, str.lower, str.title])
def test_items_in_other_case(spark, form):
    items = [(1, "Tom has 3 apples and Ann gives 2 kg of them to the Straße of ΟΔΟΣ by the River"), (2, prose(500, 40))]
    rows = [(i, f"{prose(60 + i, 20)} {form(t)} {prose(70 + i, 20)}") for i, t in items]
    rows.append((3, form(items[0][1].replace("3", "17").replace("2 kg", "5 lb"))))
    rows.append((4, form(prose(4, 60))))
    got = found(spark, items, rows)
    assert {i: r["item_ids"] for i, r in got.items()} == {1: [1], 2: [2], 3: [1], 4: []} and got[1]["coverage"] == got[2]["coverage"] == 1


def test_many_slots_in_a_row(spark):
    items = [
        (1, "Put these presidents in order of birth: Washington, Adams, Jefferson, Madison, Monroe, Jackson and then say why"),
        (2, "what comes next in the sequence 2, 3, 5, 8, 13, 21, 34 and how do you know"),
        (3, "Who Wrote The Novel Pride And Prejudice and in which year"),
        (4, "7 11 13 17 19 23 29 31 37 41"),
    ]
    rows = [(i, f"{prose(60 + i, 20)} {t} {prose(70 + i, 20)}") for i, t in items]
    rows.append((5, "what comes next in the sequence 4, 6, 10, 16, 26, 42, 68 and how do you know"))
    rows.append((6, f"{prose(7, 20)} 5 5 5 5 5 {prose(8, 20)}"))
    got = found(spark, items, rows)
    assert {i: r["item_ids"] for i, r in got.items()} == {1: [1], 2: [2], 3: [3], 4: [4], 5: [2], 6: []}
    assert all(got[i]["coverage"] == 1 for i in range(1, 6))


def test_amounts(spark):
    item = "A train travels 120km before it stops for 15min and then goes on for 80km at 90km/h until it is home"
    rows = [
        (1, item),
        (2, item.replace("120", "95").replace("15", "20").replace("80", "60").replace("90", "70")),
        (3, item.replace("0km", "0 km").replace("min", " min")),
        (4, item.upper().replace("MIN", " MIN")),
        (5, item.replace("120km", "far").replace("15min", "long").replace("80km", "more").replace("90km/h", "speed")),
    ]
    got = found(spark, [(1, item)], rows)
    assert {i: r["coverage"] for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_items_with_shared_ids(spark):
    items = [(None, prose(600, 30)), (None, prose(601, 30)), (7, prose(602, 30)), (7, prose(603, 30)), (7, prose(603, 30))]
    rows = [(i, f"{prose(60 + i, 20)} {t} {prose(70 + i, 20)}") for i, (_, t) in enumerate(items)]
    rows += [(10, f"{items[0][1]} {items[1][1]}"), (11, prose(11, 60))]
    got = found(spark, items, rows)
    assert {i: (r["contaminated"], r["item_ids"], r["coverage"]) for i, r in got.items()} == {
        0: (True, [], 1), 1: (True, [], 1), 2: (True, [7], 1), 3: (True, [7], 1), 4: (True, [7], 1), 10: (True, [], 1), 11: (False, [], 0),
    }


def test_short_items(spark):
    items = [(1, "what is 3 + 4"), (2, "Name Tom"), (3, "photosynthesis"), (4, "!?"), (5, prose(500, 40))]
    rows = [
        (1, f"{prose(1, 20)} What is 3 + 4? {prose(2, 20)}"),
        (2, "name tom"),
        (3, f"Photosynthesis {prose(3, 20)} photosynthesis, what is 3 and 4"),
        (4, f"{prose(4, 20)} what is 5 + 6 Name Ann !?"),
        (5, f"{items[4][1]} NAME TOM"),
    ]
    got = found(spark, items, rows)
    assert {i: r["item_ids"] for i, r in got.items()} == {1: [1], 2: [2], 3: [3], 4: [], 5: [2, 5]}
