"""Queries over the test tables, with the same results in SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import collapse, flagged_regex, glob_regex, identifier, quote
from .operators import relations
from .plans.compiler import Semantics, soql
from .plans.search import sosl
from .registry import ORACLE_SQL, QUERIES, plain, query
from .sources.catalogue import star_schema

AS_OF = date(1998, 6, 15)


def ask(name: str, text: str, sql: str, binds: dict | None = None, semantics: Semantics | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(soql(star_schema(spark, sf_dir), text, binds, semantics or Semantics(as_of=AS_OF)))
    ORACLE_SQL[name] = sql


def money(c: str) -> str:
    return f"CAST({c} AS DECIMAL(18,2))"


ask("soql_parent_path_agg", """SELECT Customer__r.Nation__r.n_name nation, COUNT(o_orderkey) n, SUM(o_totalprice) total FROM Orders
    WHERE o_orderdate >= 1996-01-01T00:00:00Z GROUP BY Customer__r.Nation__r.n_name ORDER BY Customer__r.Nation__r.n_name NULLS LAST""",
    f"""SELECT n_name AS nation, count(o_orderkey) AS n, CAST(sum({money('o_totalprice')}) AS DOUBLE) AS total FROM orders
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n_name""")
ask("soql_filter_order_limit", "SELECT o_orderkey, o_totalprice FROM Orders WHERE o_orderstatus = 'F' AND (o_totalprice > 1000 OR o_orderpriority LIKE '1%') ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 10",
    f"SELECT o_orderkey, CAST({money('o_totalprice')} AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND ({money('o_totalprice')} > 1000 OR o_orderpriority ILIKE '1%') ORDER BY {money('o_totalprice')} DESC, o_orderkey LIMIT 50 OFFSET 10")
ask("soql_in_subquery", "SELECT c_custkey, c_name FROM Customer WHERE c_custkey IN (SELECT o_custkey FROM Orders WHERE o_totalprice > 300) AND c_mktsegment != 'BUILDING'",
    f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {money('o_totalprice')} > 300) AND c_mktsegment <> 'BUILDING'")
ask("soql_not_in", "SELECT c_custkey FROM Customer WHERE c_custkey NOT IN (SELECT o_custkey FROM Orders WHERE o_orderstatus = 'F')",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
ask("soql_rollup", "SELECT o_orderstatus s, o_orderpriority p, GROUPING(o_orderstatus) gs, GROUPING(o_orderpriority) gp, COUNT(o_orderkey) n FROM Orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)",
    "SELECT o_orderstatus AS s, o_orderpriority AS p, GROUPING(o_orderstatus) AS gs, GROUPING(o_orderpriority) AS gp, count(o_orderkey) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)")
ask("soql_cube", "SELECT l_returnflag f, l_linestatus s, SUM(l_extendedprice) total, COUNT() n FROM Lineitem GROUP BY CUBE(l_returnflag, l_linestatus)",
    f"SELECT l_returnflag AS f, l_linestatus AS s, CAST(sum({money('l_extendedprice')}) AS DOUBLE) AS total, count(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")
ask("soql_having", "SELECT o_custkey, COUNT(o_orderkey) n, MAX(o_totalprice) top FROM Orders GROUP BY o_custkey HAVING COUNT(o_orderkey) > 10 AND MAX(o_totalprice) > 400",
    f"SELECT o_custkey, count(o_orderkey) AS n, CAST(max({money('o_totalprice')}) AS DOUBLE) AS top FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 10 AND max({money('o_totalprice')}) > 400")
ask("soql_count_scalar", "SELECT COUNT() FROM Lineitem WHERE l_returnflag = 'R'", "SELECT count(*) AS expr0 FROM lineitem WHERE l_returnflag = 'R'")
ask("soql_count_distinct", "SELECT l_returnflag f, COUNT_DISTINCT(l_partkey) parts, AVG(l_quantity) q, MIN(l_shipdate) first_ship FROM Lineitem GROUP BY l_returnflag",
    f"SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS parts, CAST(sum({money('l_quantity')}) AS DOUBLE) / count(l_quantity) AS q, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_returnflag")
ask("soql_date_functions", """SELECT o_orderkey, CALENDAR_YEAR(o_orderdate) cy, CALENDAR_QUARTER(o_orderdate) cq, CALENDAR_MONTH(o_orderdate) cm, DAY_IN_MONTH(o_orderdate) dm, DAY_IN_WEEK(o_orderdate) dw,
    DAY_IN_YEAR(o_orderdate) dy, DAY_ONLY(o_orderdate) d, HOUR_IN_DAY(o_orderdate) h, WEEK_IN_MONTH(o_orderdate) wm, WEEK_IN_YEAR(o_orderdate) wy, FISCAL_YEAR(o_orderdate) fy, FISCAL_QUARTER(o_orderdate) fq, FISCAL_MONTH(o_orderdate) fm FROM Orders""",
    """SELECT o_orderkey, year(o_orderdate) AS cy, quarter(o_orderdate) AS cq, month(o_orderdate) AS cm, day(o_orderdate) AS dm, dayofweek(o_orderdate) + 1 AS dw, dayofyear(o_orderdate) AS dy, CAST(o_orderdate AS DATE) AS d, hour(o_orderdate) AS h,
    CAST(ceil(day(o_orderdate) / 7.0) AS BIGINT) AS wm, CAST(ceil(dayofyear(o_orderdate) / 7.0) AS BIGINT) AS wy, year(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH) AS fy, quarter(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH) AS fq, month(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH) AS fm FROM orders""",
    semantics=Semantics(as_of=AS_OF, fiscal_start=7))
for _name, _formula, _lo, _hi in [
    ("today", "TODAY", "1998-06-15", "1998-06-16"), ("this_week", "THIS_WEEK", "1998-06-14", "1998-06-21"), ("last_month", "LAST_MONTH", "1998-05-01", "1998-06-01"),
    ("last_90_days", "LAST_90_DAYS", "1998-03-17", "1998-06-16"), ("last_n_days", "LAST_N_DAYS:30", "1998-05-16", "1998-06-16"), ("next_n_weeks", "NEXT_N_WEEKS:2", "1998-06-21", "1998-07-05"),
    ("n_months_ago", "N_MONTHS_AGO:3", "1998-03-01", "1998-04-01"), ("this_quarter", "THIS_QUARTER", "1998-04-01", "1998-07-01"), ("last_n_quarters", "LAST_N_QUARTERS:2", "1997-10-01", "1998-04-01"),
    ("next_year", "NEXT_YEAR", "1999-01-01", "2000-01-01"), ("n_years_ago", "N_YEARS_AGO:2", "1996-01-01", "1997-01-01"), ("this_fiscal_quarter", "THIS_FISCAL_QUARTER", "1998-05-01", "1998-08-01"),
    ("last_fiscal_year", "LAST_FISCAL_YEAR", "1997-02-01", "1998-02-01"), ("next_n_fiscal_quarters", "NEXT_N_FISCAL_QUARTERS:2", "1998-08-01", "1999-02-01"),
]:
    ask(f"soql_date_formula_{_name}", f"SELECT o_orderkey, o_custkey FROM Orders WHERE o_orderdate = {_formula}",
        f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= DATE '{_lo}' AND o_orderdate < DATE '{_hi}'", semantics=Semantics(as_of=AS_OF, fiscal_start=2))
ask("soql_date_formula_after", "SELECT o_orderkey FROM Orders WHERE o_orderdate > LAST_YEAR AND o_orderdate <= THIS_MONTH AND o_orderdate != THIS_WEEK",
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-07-01' AND NOT (o_orderdate >= DATE '1998-06-14' AND o_orderdate < DATE '1998-06-21')")
ask("soql_like", "SELECT p_partkey, p_name FROM Part WHERE p_name LIKE '%a%' AND (NOT p_type LIKE 'standard%')", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' AND NOT (p_type ILIKE 'standard%')")
ask("soql_null", "SELECT event_id, note FROM Event WHERE note = null", "SELECT event_id, CAST(NULL AS VARCHAR) AS note FROM events WHERE event_id % 4 = 0")
ask("soql_not_null", "SELECT event_id, note FROM Event WHERE note != null AND (NOT note LIKE 'c%')", "SELECT event_id, event_type AS note FROM events WHERE event_id % 4 <> 0 AND NOT event_type ILIKE 'c%'")
ask("soql_not_in_null_key", "SELECT event_id FROM Event WHERE note NOT IN (SELECT event_type FROM Event WHERE event_id < 0)", "SELECT event_id FROM events")
ask("soql_not_in_with_nulls", "SELECT c_custkey FROM Customer WHERE c_name NOT IN (SELECT note FROM Event)", "SELECT c_custkey FROM customer WHERE c_name NOT IN (SELECT CASE WHEN event_id % 4 <> 0 THEN event_type END FROM events)")
ask("soql_like_bind", "SELECT p_partkey FROM Part WHERE p_name LIKE :pattern OR p_type LIKE :other", "SELECT p_partkey FROM part WHERE p_name ILIKE '%B%' OR p_type ILIKE 'sMALL%'", binds={"pattern": "%B%", "other": "sMALL%"})
ask("soql_ignore_case", "SELECT o_orderkey FROM Orders WHERE o_orderstatus = 'f' AND o_orderpriority != :p", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f' AND lower(o_orderpriority) <> '1-urgent'", binds={"p": "1-Urgent"}, semantics=Semantics(as_of=AS_OF, ignore_case=True))
ask("soql_includes", "SELECT event_id, tags FROM Event WHERE tags INCLUDES ('click;high', 'purchase') AND tags EXCLUDES ('low')",
    f"""WITH e AS (SELECT event_id, event_type || ';' || CASE WHEN {money('value')} > 50 THEN 'high' ELSE 'low' END AS tags FROM events)
    SELECT event_id, tags FROM e WHERE (list_has_all(string_split(tags, ';'), ['click', 'high']) OR list_has_all(string_split(tags, ';'), ['purchase'])) AND NOT list_has_all(string_split(tags, ';'), ['low'])""")
ask("soql_binds", "SELECT o_orderkey FROM Orders WHERE o_custkey IN :keys AND o_totalprice >= :least ORDER BY o_orderkey LIMIT :most",
    f"SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34) AND {money('o_totalprice')} >= 100 ORDER BY o_orderkey LIMIT 25", binds={"keys": [1, 2, 3, 5, 8, 13, 21, 34], "least": 100, "most": 25})
ask("soql_fields", "SELECT FIELDS(ALL) FROM Nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
ask("soql_fields_custom", "SELECT c_custkey, FIELDS(CUSTOM) FROM Customer WHERE c_acctbal < 0", f"SELECT c_custkey, c_mktsegment FROM customer WHERE {money('c_acctbal')} < 0")
ask("soql_from_alias", "SELECT o.o_orderkey k, c.c_name cust FROM Orders o, o.Customer__r c WHERE c.c_nationkey = 7", "SELECT o_orderkey AS k, c_name AS cust FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7")
ask("soql_group_function", "SELECT CALENDAR_YEAR(o_orderdate) y, o_orderstatus, SUM(o_totalprice) FROM Orders GROUP BY CALENDAR_YEAR(o_orderdate), o_orderstatus",
    f"SELECT year(o_orderdate) AS y, o_orderstatus, CAST(sum({money('o_totalprice')}) AS DOUBLE) AS expr0 FROM orders GROUP BY ALL")


@query("soql_child_query", f"SELECT c_custkey, count(o_orderkey) AS n, CAST(max({money('o_totalprice')}) AS DOUBLE) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND {money('o_totalprice')} > 100 GROUP BY c_custkey")
def soql_child_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = soql(star_schema(spark, sf_dir), "SELECT c_custkey, (SELECT o_orderkey, o_totalprice FROM Orders WHERE o_totalprice > 100 ORDER BY o_totalprice DESC) FROM Customer")
    return df.select("c_custkey", F.size("Orders").alias("n"), F.get("Orders", F.lit(0))["o_totalprice"].alias("top"))


@query("soql_child_top", "SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def soql_child_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = soql(star_schema(spark, sf_dir), "SELECT c_custkey, (SELECT o_orderkey FROM Orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 2) FROM Customer")
    return df.select("c_custkey", F.explode("Orders.o_orderkey").alias("o_orderkey"))


@query("soql_typeof", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Customer' WHEN 1 THEN 'Supplier' ELSE 'Part' END AS kind, CASE event_id % 3 WHEN 0 THEN c_name END AS cust, CASE event_id % 3 WHEN 1 THEN s_name END AS supp
    FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN supplier ON user_id = s_suppkey""")
def soql_typeof(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = soql(star_schema(spark, sf_dir), "SELECT event_id, TYPEOF What WHEN Customer THEN c_name WHEN Supplier THEN s_name END FROM Event")
    return df.select("event_id", F.col("What.type").alias("kind"), F.col("What.c_name").alias("cust"), F.col("What.s_name").alias("supp"))


@query("soql_typeof_else", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Customer' WHEN 1 THEN 'Supplier' ELSE 'Part' END AS kind, CASE event_id % 3 WHEN 0 THEN c_name END AS cust, CASE event_id % 3 WHEN 1 THEN s_name END AS supp, CASE event_id % 3 WHEN 2 THEN p_name END AS part
    FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN supplier ON user_id = s_suppkey LEFT JOIN part ON user_id = p_partkey""")
def soql_typeof_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = soql(star_schema(spark, sf_dir), "SELECT event_id, TYPEOF What WHEN Customer THEN c_name ELSE s_name, p_name END FROM Event")
    return df.select("event_id", F.col("What.type").alias("kind"), F.col("What.c_name").alias("cust"), F.col("What.s_name").alias("supp"), F.col("What.p_name").alias("part"))


@query("soql_distance", """SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(least(pow(sin(radians(48.5 - (c_custkey % 90)) / 2), 2) + cos(radians(c_custkey % 90)) * cos(radians(48.5)) * pow(sin(radians(2.25 - (c_custkey % 180)) / 2), 2), 1.0))), 6) AS km FROM customer""")
def soql_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star_schema(spark, sf_dir)
    e = cat.get("Customer")
    load = e.load
    e.load = lambda: load().withColumn("home", F.struct((F.col("c_custkey") % 90).cast("double").alias("lat"), (F.col("c_custkey") % 180).cast("double").alias("lon")))
    df = soql(cat, "SELECT c_custkey, DISTANCE(home, GEOLOCATION(48.5, 2.25), 'km') km FROM Customer")
    return df.select("c_custkey", F.round("km", 6).alias("km"))


@query("soql_data_category", "SELECT p_partkey FROM part WHERE lower(p_brand) IN ('brand#11', 'brand#12', 'brand#13')")
def soql_data_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    sem = Semantics(categories={"p_brand": {"Brand#11": "Top", "Brand#12": "Top", "Brand#13": "Brand#12"}})
    return soql(star_schema(spark, sf_dir), "SELECT p_partkey FROM Part WITH DATA CATEGORY p_brand BELOW Top", semantics=sem)


def word(column: str, text: str) -> str:
    """SQL for a search word in a column, as a whole word."""
    return f"regexp_matches({column}, '(?:^|[^\\p{{L}}\\p{{N}}_]){text}(?:$|[^\\p{{L}}\\p{{N}}_])', 'i')"


@query("sosl_documents", f"SELECT 'Document' AS object, doc_id AS id FROM documents WHERE ({word('text', 'license')} OR {word('source', 'license')}) AND ({word('text', 'apache')} OR {word('source', 'apache')}) UNION ALL SELECT 'Page', page_id FROM pages WHERE ({word('url', 'license')} OR {word('html', 'license')}) AND ({word('url', 'apache')} OR {word('html', 'apache')})")
def sosl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sosl(star_schema(spark, sf_dir), "FIND {license AND apache} IN ALL FIELDS RETURNING Document(doc_id), Page(page_id)")
    return got["Document"].select(F.lit("Document").alias("object"), F.col("doc_id").alias("id")).unionAll(got["Page"].select(F.lit("Page").alias("object"), F.col("page_id").alias("id")))


_GAP = r"[^\p{L}\p{N}_]+"


@query("sosl_groups", f"SELECT doc_id FROM documents WHERE ({word('text', 'the')} OR {word('text', 'und')}) AND {word('text', 'with')} AND NOT ({word('text', f'apache{_GAP}license')} OR {word('text', 'by')})")
def sosl_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star_schema(spark, sf_dir)
    cat.get("Document").search = {"all": ("text",)}
    return sosl(cat, 'FIND {(the OR und) AND with AND NOT ("apache license" OR by)} IN ALL FIELDS RETURNING Document(doc_id)')["Document"]


@query("sosl_wildcards", r"SELECT n_nationkey FROM nation WHERE regexp_matches(n_name, '(?:^|[^\p{L}\p{N}_])(?:united[\p{L}\p{N}_]*|[\p{L}\p{N}_]*an|j[\p{L}\p{N}_]{3}an)(?:$|[^\p{L}\p{N}_])', 'i')")
def sosl_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sosl(star_schema(spark, sf_dir), "FIND {united* OR *an OR j???an} IN NAME FIELDS RETURNING Nation(n_nationkey)")["Nation"]


@query("sosl_overall_limit", "SELECT object, count(*) AS n FROM (SELECT 'Nation' AS object FROM nation WHERE n_name ILIKE '%a%' UNION ALL SELECT 'Region' FROM (SELECT 1 FROM region WHERE r_name ILIKE '%a%' LIMIT 3)) GROUP BY object")
def sosl_overall_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star_schema(spark, sf_dir)
    n = cat.frame(cat.get("Nation")).where(F.lower("n_name").contains("a")).count()
    got = sosl(cat, f"FIND {{*a*}} IN NAME FIELDS RETURNING Nation(n_name), Region(r_name) LIMIT {n + 3}")
    return got["Nation"].select(F.lit("Nation").alias("object")).unionAll(got["Region"].select(F.lit("Region").alias("object"))).groupBy("object").agg(F.count(F.lit(1)).alias("n"))


@query("sosl_where_order_limit", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' AND p_size > 10 ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 5")
def sosl_where_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sosl(star_schema(spark, sf_dir), "FIND :word IN NAME FIELDS RETURNING Part(p_partkey, p_name WHERE p_size > 10 ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 5)", {"word": "*a*"})["Part"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("text_glob", "SELECT doc_id FROM documents WHERE regexp_matches(text, '^(?:.*(?:the|der) .*ing.*)$', 'is')")
def text_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where(F.col("text").rlike(glob_regex("*{the,der} *ing*"))).select("doc_id")


@query("text_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}\\.[0-9]+|licen[sc]e', 'i')")
def text_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where(F.col("text").rlike(flagged_regex(r"/[0-9]{3}\.[0-9]+|licen[sc]e/i"))).select("doc_id")


@query("text_not", "SELECT doc_id FROM documents WHERE source = 'src0' AND NOT regexp_matches(text, '^(?:.*q.*)$', 'is')")
def text_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where((F.col("source") == "src0") & ~F.coalesce(F.col("text").rlike(glob_regex("*q*")), F.lit(False))).select("doc_id")


@query("text_collapse", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def text_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(collapse(F.col("text")), 256).alias("h"))


@query("text_quote", "SELECT item_id, replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\', '\\\\'), '''', '\\''') AS q FROM benchmark")
def text_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", quote(F.col("text")).alias("q"))


@query("text_id", """SELECT p_partkey, CASE WHEN len(w) = 0 THEN 'x' ELSE (CASE WHEN regexp_matches(w[1], '^[0-9]') THEN 'k' ELSE '' END) || w[1] || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || x[2:]), '') END AS name
    FROM (SELECT p_partkey, list_filter(regexp_split_to_array(p_name || '.' || p_brand, '[^A-Za-z0-9_]+'), lambda x: x <> '') AS w FROM part)""")
def text_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", identifier(F.concat("p_name", F.lit("."), "p_brand")).alias("name"))


@query("text_line_index", """SELECT doc_id, line, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, strlen(t) AS bytes
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)""")
def text_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.line_table(_documents(spark, sf_dir), "doc_id", "text").select("doc_id", "line", "start", F.octet_length("text").alias("bytes"))


@query("text_line_col", """WITH l AS (SELECT doc_id, line, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, strlen(t) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents))
    SELECT d.doc_id, CAST(strlen(d.text) // 2 AS BIGINT) AS "offset", l.line, strlen(d.text) // 2 - l.start + 1 AS col FROM documents d JOIN l ON l.doc_id = d.doc_id AND strlen(d.text) // 2 >= l.start AND strlen(d.text) // 2 < l.start + l.n + 1""")
def text_line_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    points = docs.select("doc_id", F.floor(F.octet_length("text") / 2).alias("offset"))
    return relations.line_col(points, relations.line_table(docs, "doc_id", "text"), "doc_id")


_EDGES = """(SELECT c_custkey AS a, c_custkey * 7 % 50 AS b FROM customer UNION SELECT c_custkey, c_nationkey FROM customer)"""


@query("graph_closure", f"""WITH RECURSIVE e AS (SELECT DISTINCT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM {_EDGES} WHERE a <> b), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t WHERE a <> b""")
def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer reaches by two cyclic rules over all customers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    one = c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") * 7 % 50).alias("b"))
    two = c.select(F.col("c_custkey").alias("a"), F.col("c_nationkey").cast("long").alias("b"))
    return relations.closure(one.union(two).distinct(), "a", "b").select("a", "b")


@query("graph_closure_all", """WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
    t AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t WHERE b IS NOT NULL""")
def graph_closure_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers, suppliers and nations with all that is above them."""
    def edges(table: str, a: str, source: str, b: str, target: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.concat(F.lit(a), source).alias("a"), F.concat(F.lit(b), target).alias("b"))

    e = edges("orders", "o", "o_orderkey", "c", "o_custkey").union(edges("customer", "c", "c_custkey", "n", "c_nationkey"))
    e = e.union(edges("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(edges("nation", "n", "n_nationkey", "r", "n_regionkey"))
    return relations.closure(e, "a", "b").select("a", "b")


@query("interval_innermost", """WITH iv AS (SELECT conv_id, turn AS id, turn AS lo, turn + 1 + (turn * 5 + conv_id) % 4 AS hi FROM conversations), p AS (SELECT conv_id, turn AS point FROM conversations)
    SELECT conv_id, point, id FROM (SELECT p.conv_id, p.point, iv.id, row_number() OVER (PARTITION BY p.conv_id, p.point ORDER BY iv.hi - iv.lo, iv.lo, iv.id) AS r FROM p LEFT JOIN iv ON iv.conv_id = p.conv_id AND p.point >= iv.lo AND p.point < iv.hi) WHERE r = 1""")
def interval_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    iv = c.select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("lo"), (F.col("turn") + 1 + (F.col("turn") * 5 + F.col("conv_id")) % 4).alias("hi"))
    return relations.innermost(c.select("conv_id", F.col("turn").alias("point")), iv, ["conv_id"], "point", "lo", "hi", "id", 4)


@query("anti_dead", f"SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND {money('l_quantity')} > 48)")
def anti_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_quantity").cast("decimal(18,2)") > 48)
    return spark.read.parquet(f"{sf_dir}/part.parquet").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("fix_overlap", """WITH e AS (SELECT l_orderkey AS g, CAST(l_linenumber AS BIGINT) AS id, CAST(l_linenumber * 3 AS BIGINT) AS s, CAST(l_linenumber * 3 + 1 + CAST(l_quantity AS BIGINT) % 9 AS BIGINT) AS e FROM lineitem)
    SELECT g, id, s, e, CASE WHEN sub THEN 'subsumed' WHEN crossed THEN 'crossing' ELSE 'ok' END AS status FROM (SELECT a.g, a.id, a.s, a.e,
    bool_or(coalesce(b.s <= a.s AND a.e <= b.e AND (b.e - b.s > a.e - a.s OR b.id < a.id), false)) AS sub, bool_or(coalesce(NOT ((a.s <= b.s AND b.e <= a.e) OR (b.s <= a.s AND a.e <= b.e)), false)) AS crossed
    FROM e a LEFT JOIN e b ON a.g = b.g AND a.id <> b.id AND a.s < b.e AND b.s < a.e GROUP BY a.g, a.id, a.s, a.e)""")
def fix_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    e = li.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("long").alias("id"), (F.col("l_linenumber") * 3).cast("long").alias("s"), (F.col("l_linenumber") * 3 + 1 + F.col("l_quantity").cast("long") % 9).cast("long").alias("e"))
    return relations.overlap_status(e, "g", "s", "e", "id")


@query("edit_outermost", """WITH e AS (SELECT l_orderkey AS g, CAST(l_linenumber AS BIGINT) AS id, CAST(l_linenumber * 3 AS BIGINT) AS s, CAST(l_linenumber * 3 + 1 + CAST(l_quantity AS BIGINT) % 9 AS BIGINT) AS e FROM lineitem)
    SELECT g, id, s, e FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE a.g = b.g AND b.s <= a.s AND a.e <= b.e AND (b.s < a.s OR a.e < b.e))""")
def edit_outermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    e = li.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("long").alias("id"), (F.col("l_linenumber") * 3).cast("long").alias("s"), (F.col("l_linenumber") * 3 + 1 + F.col("l_quantity").cast("long") % 9).cast("long").alias("e"))
    return relations.outermost(e, "g", "s", "e")


@query("lookup_prioritised", """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey AND r = 1""")
def lookup_prioritised(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderkey")
    return relations.prioritised(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), o, ["c_custkey"], "o_orderpriority").select("c_custkey", "o_orderkey")


@query("duplicate_in_group", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r > 1")
def duplicate_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return c.withColumn("r", F.row_number().over(w)).where("r > 1").select("conv_id", "turn", "role")


from . import source_queries  # noqa: E402,F401  registers its queries
