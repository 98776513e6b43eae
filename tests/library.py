"""A small library domain with several designs of the same rows."""

from prismal.model import NESTED, Attribute, Design, Domain, End, Subclass
from prismal.operators.catalog import Catalog


def books():
    d = Domain("books")
    d.add_class("Book", Attribute("B_ID", "Integer", identifier=True), Attribute("B_title", "String", 40))
    d.add_class("Author", Attribute("A_ID", "Integer", identifier=True), Attribute("A_name", "String", 40), Attribute("A_age", "Integer"))
    d.add_class("Topic", Attribute("T_ID", "Integer", identifier=True), Attribute("T_name", "String", 40))
    d.add_association("Writes", End("Writes_Author", "Author", 1, 1), End("Writes_Book", "Book", 1, 20))
    d.add_association("Touches", End("Touches_Topic", "Topic", 0, 5), End("Touches_Book", "Book", 0, 8000))
    return d


def plain(d):
    x = Design(d, "plain")
    x.add_struct("book_t", ["Book"], ["B_ID", "B_title"])
    x.add_set("books", "book_t")
    x.add_struct("author_t", ["Author"], ["A_ID", "A_name", "A_age"])
    x.add_set("authors", "author_t")
    x.add_struct("topic_t", ["Topic"], ["T_ID", "T_name"])
    x.add_set("topics", "topic_t")
    x.add_struct("writes_t", ["Writes"])
    x.add_set("writes", "writes_t")
    x.add_struct("touches_t", ["Touches"])
    x.add_set("touches", "touches_t")
    return x


def rest(x):
    x.add_struct("topic_t", ["Topic"], ["T_ID", "T_name"])
    x.add_set("topics", "topic_t")
    x.add_struct("touches_t", ["Touches"])
    x.add_set("touches", "touches_t")
    return x


def foreign_key(d):
    x = Design(d, "foreign_key")
    x.add_struct("book_t", ["Book"], ["B_ID", "B_title", "Writes"])
    x.add_set("books", "book_t")
    x.add_struct("author_t", ["Author"], ["A_ID", "A_name", "A_age"])
    x.add_set("authors", "author_t")
    return rest(x)


def one_table(d):
    x = Design(d, "one_table")
    x.add_struct("book_t", ["Book"], ["B_ID", "B_title", "Writes", "Author", "A_name", "A_age"])
    x.add_set("books", "book_t")
    return rest(x)


def contained(d):
    x = Design(d, "contained")
    x.add_struct("book_t", ["Book"], ["B_ID", "B_title", "Writes", "Author"])
    x.add_set("books", "book_t")
    x.add_struct("author_t", ["Author"], ["A_ID", "A_name", "A_age"])
    x.add_set("authors", "author_t")
    return rest(x)


def split(d):
    x = Design(d, "split")
    x.add_struct("book_t", ["Book"], ["B_ID", "B_title", "Writes"])
    x.add_set("books", "book_t")
    x.add_struct("author1_t", ["Author"], ["A_ID", "A_name"])
    x.add_set("authors1", "author1_t")
    x.add_struct("author2_t", ["Author"], ["A_ID", "A_age"])
    x.add_set("authors2", "author2_t")
    return rest(x)


def nested(d):
    x = Design(d, "nested", NESTED)
    x.add_struct("author_in", ["Author"], ["A_ID", "A_name", "A_age"])
    x.add_struct("topic_in", ["Topic"], ["T_ID", "T_name"])
    x.add_set("topic_list", "topic_in")
    x.add_struct("book_t", ["Book"], ["B_ID", "B_title", "Writes", "author_in", "Touches", "topic_list"])
    x.add_set("books", "book_t")
    x.add_struct("topic_t", ["Topic"], ["T_ID", "T_name"])
    x.add_set("topics", "topic_t")
    return x


DESIGNS = (plain, foreign_key, one_table, contained, split, nested)


def catalog(spark):
    d = books()
    frame = spark.createDataFrame
    return Catalog(
        spark,
        plain(d),
        {
            "books": frame([(1, "one"), (2, "two"), (3, "three")], "B_ID int, B_title string"),
            "authors": frame([(11, "ann", 30), (12, "bob", None)], "A_ID int, A_name string, A_age int"),
            "topics": frame([(21, "sea"), (22, "sky"), (23, "none")], "T_ID int, T_name string"),
            "writes": frame([(11, 1), (12, 2), (11, 3)], "Writes_Author int, Writes_Book int"),
            "touches": frame([(21, 1), (22, 1), (21, 2)], "Touches_Topic int, Touches_Book int"),
        },
    )


def machines():
    """Machines of a yard, told apart by power; vehicles have a crew and tow other machines."""
    d = Domain("yard")
    d.add_class("Machine", Attribute("M_no", "Integer", identifier=True), Attribute("M_power", "Integer"), Attribute("M_yard", "String", 12))
    d.add_class("Handheld", Attribute("H_battery", "String", 12))
    d.add_class("Vehicle", Attribute("V_plate", "String", 8))
    d.add_class("Crew", Attribute("C_code", "String", 6, identifier=True), Attribute("C_lead", "String", 20))
    d.add_generalization("ByPower", "Machine", Subclass("Handheld", "M_power < 50"), Subclass("Vehicle", "M_power >= 50"))
    d.add_association("Mans", End("manned_by", "Crew", 1, 1), End("mans", "Vehicle", 0, None))
    d.add_association("Tows", End("tower", "Vehicle", 0, None), End("towed", "Machine", 0, None))
    return d


def around(x):
    x.add_struct("crew_t", ["Crew"], ["C_code", "C_lead"])
    x.add_set("crews", "crew_t")
    x.add_struct("tows_t", ["Tows"])
    x.add_set("tows", "tows_t")
    return x


MACHINE = ["M_no", "M_power", "M_yard"]


def table_per_class(d):
    x = Design(d, "table_per_class")
    x.add_struct("machine_t", ["Machine"], MACHINE)
    x.add_set("machines", "machine_t")
    x.add_struct("handheld_t", ["Handheld"], ["H_battery"])
    x.add_set("handhelds", "handheld_t")
    x.add_struct("vehicle_t", ["Vehicle"], ["V_plate", "Mans"])
    x.add_set("vehicles", "vehicle_t")
    return around(x)


def all_in_one(d):
    x = Design(d, "all_in_one")
    x.add_struct("machine_t", ["Machine"], MACHINE)
    x.add_struct("handheld_t", ["Handheld"], [*MACHINE, "H_battery"])
    x.add_struct("vehicle_t", ["Vehicle"], [*MACHINE, "V_plate", "Mans"])
    x.add_set("machines", "machine_t", "handheld_t", "vehicle_t")
    return around(x)


def per_subclass(d):
    x = Design(d, "per_subclass")
    x.add_struct("handheld_t", ["Handheld"], [*MACHINE, "H_battery"])
    x.add_set("handhelds", "handheld_t")
    x.add_struct("vehicle_t", ["Vehicle"], [*MACHINE, "V_plate", "Mans"])
    x.add_set("vehicles", "vehicle_t")
    return around(x)


def yard_catalog(spark):
    frame = spark.createDataFrame
    return Catalog(
        spark,
        table_per_class(machines()),
        {
            "machines": frame([(7, 20, "north"), (8, 90, "south"), (9, 300, "north"), (10, 2, None)], "M_no int, M_power int, M_yard string"),
            "handhelds": frame([(7, "lithium"), (10, "none")], "M_no int, H_battery string"),
            "vehicles": frame([(8, "AB-1", "red"), (9, "CD-2", "blue")], "M_no int, V_plate string, manned_by string"),
            "crews": frame([("red", "ann"), ("blue", "bob"), ("grey", None)], "C_code string, C_lead string"),
            "tows": frame([(8, 7), (9, 8), (9, 10)], "tower int, towed int"),
        },
    )


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))
