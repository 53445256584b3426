from datetime import date

import pytest

from lakewright.plans.compiler import Semantics, soql, soql_count
from lakewright.plans.dates import interval
from lakewright.plans.search import sosl
from lakewright.plans.soql_ast import DateFormula, QueryError
from lakewright.plans.soql_parser import parse_query, parse_search, result_type
from lakewright.sources.catalogue import Catalogue, Entity, Lookup, star_schema


@pytest.mark.parametrize("text", [
    "SELECT Id FROM A WHERE x = 1 OR y = 2 AND z = 3",
    "SELECT Id FROM A WHERE NOT x = 1 AND y = 2",
    "SELECT Id FROM A WHERE d = LAST_N_DAYS",
    "SELECT Id FROM A LIMIT 1.5",
    "SELECT SUM(COUNT(x)) FROM A",
    "SELECT Id FROM A WHERE x = (SELECT Id FROM B)",
    "SELECT FOO(x) FROM A",
    "SELECT Id FROM A FOR NOTHING",
    "SELECT Id, (SELECT Id FROM B GROUP BY Id) FROM A",
    "SELECT Id FROM A WHERE x ~ 1",
    "FROM A",
    "SELECT Id FROM A extra words",
])
def test_rejected(text):
    with pytest.raises(QueryError):
        parse_query(text)


@pytest.mark.parametrize("text", [
    "SELECT Id FROM A USING SCOPE mine WHERE x INCLUDES ('a;b', 'c') WITH SECURITY_ENFORCED ORDER BY x ASC NULLS FIRST, y DESC LIMIT :n OFFSET 3 ALL ROWS FOR VIEW FOR REFERENCE UPDATE TRACKING",
    "SELECT TYPEOF What WHEN A THEN x, y WHEN B THEN z ELSE w END, FORMAT(convertCurrency(p)) q FROM E",
    "SELECT DISTANCE(loc, GEOLOCATION(1.5, -2), 'mi') FROM A WHERE DISTANCE(loc, :here, 'km') < 5.5 WITH DATA CATEGORY g AT (a, b) AND h BELOW c",
    "SELECT CALENDAR_YEAR(convertTimezone(d)) FROM A WHERE p > USD25000 AND t = 2020-01-01T10:00:00+02:00 AND b != true AND s <> null",
    "[SELECT Id FROM A WHERE (NOT x = 1) AND (y = 2 OR z IN (1, 2, :k))]",
])
def test_accepted(text):
    parse_query(text)


def test_search_grammar():
    s = parse_search("FIND {a AND b} IN NAME FIELDS RETURNING A(Id, x WHERE y = 1 ORDER BY x LIMIT 2), B WITH SNIPPET(TARGET_LENGTH = 50) WITH HIGHLIGHT LIMIT 9")
    assert s.term == "a AND b" and [r.source for r in s.returning] == ["A", "B"] and s.with_["highlight"]
    with pytest.raises(QueryError):
        parse_search("FIND")


def test_result_types():
    assert result_type(parse_query("SELECT COUNT() FROM A")) == "Integer"
    assert result_type(parse_query("SELECT COUNT(x) FROM A")) == "List<AggregateResult>"
    assert result_type(parse_query("SELECT x FROM A GROUP BY x")) == "List<AggregateResult>"
    assert result_type(parse_query("SELECT x FROM A")) == "List<A>"


@pytest.mark.parametrize("name,n,lo,hi", [
    ("today", None, date(2024, 2, 29), date(2024, 3, 1)), ("last_week", None, date(2024, 2, 18), date(2024, 2, 25)), ("this_month", None, date(2024, 2, 1), date(2024, 3, 1)),
    ("next_quarter", None, date(2024, 4, 1), date(2024, 7, 1)), ("last_n_days", 3, date(2024, 2, 26), date(2024, 3, 1)), ("n_days_ago", 2, date(2024, 2, 27), date(2024, 2, 28)),
    ("next_n_months", 2, date(2024, 3, 1), date(2024, 5, 1)), ("n_quarters_ago", 1, date(2023, 10, 1), date(2024, 1, 1)), ("last_n_years", 2, date(2022, 1, 1), date(2024, 1, 1)),
    ("this_fiscal_year", None, date(2023, 7, 1), date(2024, 7, 1)), ("n_fiscal_quarters_ago", 1, date(2023, 10, 1), date(2024, 1, 1)), ("last_90_days", None, date(2023, 12, 1), date(2024, 3, 1)),
])
def test_date_formulas(name, n, lo, hi):
    assert interval(DateFormula(name, n), date(2024, 2, 29), 6, 7) == (lo, hi)


@pytest.fixture(scope="module")
def tiny(spark):
    a = spark.createDataFrame([(1, "x", 10, False), (2, None, None, False), (3, "Y", 30, True), (4, "z", 99, False)], "id int, name string, bid int, gone boolean")
    b = spark.createDataFrame([(10, "ten"), (30, None)], "id int, label string")
    return Catalogue([Entity("A", lambda: a, ("id",), {"B__r": Lookup("bid", ("B",))}, deleted="gone"), Entity("B", lambda: b, ("id",), children={"As": ("A", "bid")})])


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_semantics(tiny):
    assert rows(soql(tiny, "SELECT id, B__r.label l FROM A ORDER BY name")) == [(2, None), (1, "ten"), (4, None)]
    assert rows(soql(tiny, "SELECT id FROM A ORDER BY name DESC NULLS LAST ALL ROWS")) == [(4,), (1,), (3,), (2,)]
    assert rows(soql(tiny, "SELECT id FROM A WHERE name = null")) == [(2,)]
    assert rows(soql(tiny, "SELECT id FROM A WHERE bid NOT IN (SELECT id FROM B)")) == [(4,)]
    assert rows(soql(tiny, "SELECT id FROM B WHERE id NOT IN (SELECT bid FROM A)")) == []
    assert soql_count(tiny, "SELECT COUNT() FROM A") == 3
    assert rows(soql(tiny, "SELECT id, (SELECT name FROM As) FROM B ORDER BY id")) == [(10, [("x",)]), (30, [])]
    assert rows(soql(tiny, "SELECT id FROM A WHERE name LIKE 'X'")) == [(1,)]


def test_unknown_names(tiny):
    for text in ("SELECT id FROM C", "SELECT nope FROM A", "SELECT X__r.id FROM A", "SELECT id, (SELECT id FROM Kids) FROM B", "SELECT name, COUNT(id) FROM A", "SELECT id FROM A USING SCOPE mine"):
        with pytest.raises(QueryError):
            soql(tiny, text)


def test_filters_reach_the_scan(spark, sf_dir):
    df = soql(star_schema(spark, sf_dir), "SELECT o_orderkey, Customer__r.c_name FROM Orders WHERE o_orderdate >= 1996-01-01T00:00:00Z AND o_orderstatus = 'F'", semantics=Semantics())
    plan = df._jdf.queryExecution().toString()
    scan = plan[plan.rindex("== Physical Plan =="):]
    assert "GreaterThanOrEqual(o_orderdate" in scan and "EqualTo(o_orderstatus,F)" in scan
    assert "o_totalprice" not in scan


def test_search_results(spark, sf_dir):
    got = sosl(star_schema(spark, sf_dir), "FIND {germ* OR \"FRANCE\"} IN NAME FIELDS RETURNING Nation(n_name) WITH HIGHLIGHT")["Nation"]
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_name ilike '%germ%' or n_name ilike '%france%'").count()
    assert got.count() == n and "highlight" in got.columns
