"""Driver queries: the operators on the test tables, with the same in DuckDB's SQL.

The test tables hold no source code, so the relational operators run on stand-ins for their
inputs: a customer is a file and their orders its functions, a part's brand is a type name,
and so on; those of ``table_queries`` make syntax, symbols and source texts of them.  The
``CASES`` run on the sources of ``rule_cases`` and ``samples``, with the values that the rules
give by hand; they are tests, and no queries of the driver.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rule_cases, samples
from .functions import text as fmt
from .operators import cohesion, metrics, summaries, thresholds
from .operators.metrics import continued
from .plans import service
from .plans.analysis import Analysis, analyze, analyze_code, analyze_sources, batch_analyze, rules_for
from .plans.report_sink import read_lines, write_report
from .plans.reports import described, read_results, report_rows
from .sources.files import Rules, chosen, collect_files, env_threshold, excluded, strings
from .sources.storage import new_path, stored
from .table_queries import WITH_ORACLE as ON_TABLES
from .table_queries import table

RULES = [("Brand#1", None, 22), (None, "3", 8), ("Brand#2", "5", 31), (None, None, 2), ("Brand", "9", 44)]
DEFAULT_THRESHOLD = 18
RULES_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in RULES) + ") AS rules(prefix, suffix, threshold)"


def order_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as functions of a file: priority as cyclomatic, days of the month as cognitive complexity."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("file_path"),
        F.col("o_orderkey").alias("pos"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("cyclomatic"),
        F.dayofmonth("o_orderdate").alias("cognitive"),
    )


ORDER_FUNCTIONS = "SELECT o_custkey AS file_path, o_orderkey AS pos, o_orderpriority[1]::INT AS cyclomatic, day(o_orderdate)::INT AS cognitive FROM orders"


def part_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions: the brand is the enclosing type, the size cyclomatic, the price's tens cognitive complexity; with thresholds."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("enclosing_type"), F.col("p_size").alias("cyclomatic"), (F.floor("p_retailprice") % 45).cast("int").alias("cognitive"))
    rules = spark.createDataFrame(RULES, "prefix string, suffix string, threshold int")
    return thresholds.with_threshold(parts, rules, None, DEFAULT_THRESHOLD)


PART_FUNCTIONS = f"""
SELECT p_partkey, p_name AS name, p_brand AS enclosing_type, p_size AS cyclomatic, (floor(p_retailprice) % 45)::INT AS cognitive,
       coalesce((SELECT min(threshold) FROM {RULES_SQL}
                 WHERE (prefix IS NOT NULL OR suffix IS NOT NULL) AND (prefix IS NULL OR starts_with(p_brand, prefix)) AND (suffix IS NULL OR ends_with(p_brand, suffix))), {DEFAULT_THRESHOLD})::INT AS threshold
FROM part
"""


def file_summary(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_path"))
    return summaries.file_summary(files, order_functions(spark, sf_dir))


def strictest_threshold(spark, sf_dir):
    return part_functions(spark, sf_dir).select("p_partkey", "enclosing_type", "threshold")


def exceeded_functions(spark, sf_dir):
    return thresholds.exceeding(part_functions(spark, sf_dir)).select("p_partkey", "cyclomatic", "cognitive", "threshold")


def any_exceeded(spark, sf_dir):
    return thresholds.any_exceeded(part_functions(spark, sf_dir))


def file_filter_recompute(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_quantity").cast("int").alias("cyclomatic"), F.col("l_linenumber").alias("cognitive"), F.lit(40).alias("threshold"))
    left = thresholds.exceeding(items)
    return summaries.file_summary(left, left)


def bands(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", fmt.ui_band(size).alias("ui_band"), fmt.risk_band(size).alias("risk_band"), fmt.cognitive_band(size).alias("cognitive_band"))


def shop_graph(spark, sf_dir):
    """Customers as types, their orders as methods, the parts they hold as properties."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("type_pos"), F.col("o_orderkey").cast("string").alias("name"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("name"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return orders, orders.join(items, "name").select("type_pos", F.col("name").alias("src"), "dst")


def component_count(spark, sf_dir):
    return cohesion.count_components(*shop_graph(spark, sf_dir), ["type_pos"])


COMPONENTS = """
WITH RECURSIVE link AS (
  SELECT DISTINCT a.o_custkey AS t, a.o_orderkey AS x, b.o_orderkey AS y
  FROM orders a JOIN lineitem la ON la.l_orderkey = a.o_orderkey JOIN lineitem lb ON lb.l_partkey = la.l_partkey JOIN orders b ON b.o_orderkey = lb.l_orderkey AND b.o_custkey = a.o_custkey
), reach(t, x, y) AS (
  SELECT o_custkey, o_orderkey, o_orderkey FROM orders
  UNION SELECT r.t, r.x, l.y FROM reach r JOIN link l ON l.t = r.t AND l.x = r.y
), low AS (SELECT t, x, min(y) AS label FROM reach GROUP BY t, x)
SELECT t AS type_pos, count(DISTINCT label) AS components FROM low GROUP BY t
"""


def cohesion_level_summary(spark, sf_dir):
    counts = stored(component_count(spark, sf_dir), "components")  # two sums read them
    rows = counts.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("type_pos"), F.col("c_nationkey").alias("file_path")), "type_pos")
    scored = rows.select("file_path", F.col("components").alias("lcom4")).withColumn("level", cohesion.cohesion_level(F.col("lcom4")))
    levels = scored.groupBy("file_path").agg(F.count_if(F.col("level") == "high").alias("n_high"), F.count_if(F.col("level") == "moderate").alias("n_moderate"))
    return summaries.cohesion_summary(scored).join(levels, "file_path")


def logical_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").isin("click", "view").alias("logical"))
    rows = events.select("user_id", continued(["user_id"], ["ts", "event_id"], F.col("logical")).alias("extra"))
    return rows.groupBy("user_id").agg(F.sum("extra").alias("extra"))


def exclude_regex(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.where(~excluded(F.col("url"), ["/de/", "[?]utm_", "*bad", r"\.org/"]))


def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fmt.xml_escaped(F.col("html")).alias("escaped"))


def text_row_pad(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    rows = parts.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))
    average = F.col("total") / F.col("n")
    return rows.select("p_brand", "p_type", F.concat(fmt.padded(F.col("p_type"), 20), F.lit("|"), fmt.padded(F.col("total"), 10), F.lit("|"), fmt.fixed(average, 1), F.lit("|"), fmt.fixed(average, 2)).alias("line"))


def trimmed_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(fmt.trimmed(F.concat(F.lit(" \t\n"), "text", F.lit("\n\t "), F.lit("\r")), " \t\n\r")).cast("long").alias("n"))


def cognitive_points(spark, sf_dir):
    """The weights of nested control flow: event types stand for kinds, the value's units for depth."""
    kinds = {"view": "if", "click": "while", "purchase": "guard", "signup": "switch"}
    kind = F.coalesce(*(F.when(F.col("event_type") == e, F.lit(k)) for e, k in kinds.items()), F.lit("break"))
    rows = table(spark, sf_dir, "events").select("user_id", kind.alias("kind"), F.lit(None).cast("string").alias("name"), (F.col("event_id") % 3 == 0).alias("is_else_if"), (F.floor("value") % 4).cast("int").alias("depth"))
    points = rows.select("user_id", metrics.cyclomatic_points().cast("long").alias("cyclomatic"), metrics.cognitive_points(F.col("depth")).cast("long").alias("cognitive"))
    return points.groupBy("user_id").agg((1 + F.sum("cyclomatic")).alias("cyclomatic"), F.sum("cognitive").alias("cognitive"))


def member_counts(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "type_pos")
    methods, properties = items.where("l_returnflag = 'N'"), items.where("l_linestatus = 'O' and l_tax > 0.04")
    return cohesion.counted_members(methods, properties, ["type_pos"])


def first_symbol(spark, sf_dir):
    """Parts as symbols: of those that share brand and type, the first."""
    kind = F.when(F.col("p_size") % 2 == 0, "class").when(F.col("p_size") % 3 == 0, "struct").otherwise("enum")
    return cohesion.homes(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("usr"), F.concat_ws("/", "p_brand", "p_type").alias("name"), kind.alias("kind")))


def method_accesses(spark, sf_dir):
    """Orders as methods that name the parts they hold; large parts are the properties of all their customers' types."""
    _, uses = shop_graph(spark, sf_dir)
    sized = table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    names = uses.select("type_pos", F.col("src").alias("id"), F.col("dst").alias("name"))
    properties = names.select("type_pos", "name").distinct().join(sized, "name", "left_semi")
    return cohesion.accessed(names, properties, ["type_pos"])


def lcom4_of_shop(spark, sf_dir):
    """Customers as types with orders as methods, of which urgent ones call ``m1``, and parts as properties."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("type_pos"), F.col("o_orderkey").alias("id"), F.concat(F.lit("m"), (F.col("o_orderkey") % 5).cast("string")).alias("name"), (F.col("o_orderkey") % 3 > 0).alias("has_body"), "o_orderpriority")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 40).cast("string").alias("property"))
    accesses = orders.join(items.where("property <> '0'"), "id").select("type_pos", "id", "property").distinct()
    properties = accesses.where("type_pos % 4 > 0").select("type_pos", F.col("property").alias("name")).distinct()
    calls = orders.where("o_orderpriority like '1%'").select("type_pos", "name", F.lit("m1").alias("callee"))
    known = orders.select("type_pos", F.col("name").alias("callee")).distinct()
    return cohesion.lcom4(orders.drop("o_orderpriority"), properties, accesses, calls.join(known, ["type_pos", "callee"], "left_semi"), ["type_pos"])


LCOM4_OF_SHOP = """
WITH RECURSIVE method AS (
  SELECT o_custkey AS t, o_orderkey AS id, 'm' || (o_orderkey % 5) AS name, o_orderkey % 3 > 0 AS has_body, o_orderpriority LIKE '1%' AS calls FROM orders
), used AS (
  SELECT DISTINCT t, id, l_partkey % 40 AS property FROM method JOIN lineitem ON l_orderkey = id WHERE l_partkey % 40 <> 0
), owned AS (
  SELECT t, count(DISTINCT property) AS properties FROM used WHERE t % 4 > 0 GROUP BY t
), sized AS (
  SELECT t, count(*) AS methods, coalesce(any_value(properties), 0) AS properties FROM method LEFT JOIN owned USING (t) GROUP BY t
), speaking AS (
  SELECT t, name, max(id) AS id FROM method WHERE has_body GROUP BY t, name
), touch AS (
  SELECT s.t, s.name, property FROM speaking s JOIN used u ON u.t = s.t AND u.id = s.id
), called AS (
  SELECT DISTINCT m.t, m.name FROM method m JOIN method o ON o.t = m.t AND o.name = 'm1' WHERE m.calls AND m.name <> 'm1'
), link AS (
  SELECT DISTINCT a.t, a.name AS x, b.name AS y FROM touch a JOIN touch b ON a.t = b.t AND a.property = b.property
  UNION SELECT t, name, 'm1' FROM called UNION SELECT t, 'm1', name FROM called
), reach(t, x, y) AS (
  SELECT DISTINCT t, name, name FROM method UNION SELECT r.t, r.x, l.y FROM reach r JOIN link l ON l.t = r.t AND l.x = r.y
), label AS (
  SELECT t, count(DISTINCT low) AS components FROM (SELECT t, x, min(y) AS low FROM reach GROUP BY t, x) GROUP BY t
)
SELECT t AS type_pos, (CASE WHEN properties = 0 THEN 0 WHEN methods = 1 THEN 1 ELSE components END)::INT AS lcom4 FROM sized JOIN label USING (t)
"""


def chosen_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    first, second = pages.where("url like 'https:%'").select(F.col("url").alias("file_path")), pages.where("url like '%/en/%'").select(F.col("url").alias("file_path"))
    return chosen(first.unionByName(second), ["/de/", "*bad"], ["*7", "*[?]*"])


# ---- customers as files, their orders as functions, suppliers as types: what reports are made of


def shop_analysis(spark, sf_dir) -> Analysis:
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("<C>"), F.col("c_custkey").cast("string")).alias("file_path"), (F.col("c_custkey") % 3 == 0).alias("has_types"))
    functions = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("<C>"), F.col("o_custkey").cast("string")).alias("file_path"),
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string")).alias("name"),
        F.concat(F.lit("func f<T & '"), F.col("o_orderpriority"), F.lit("'>()")).alias("signature"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("cyclomatic"),
        F.dayofmonth("o_orderdate").alias("cognitive"),
        (F.col("o_orderkey") % 97 + 1).cast("int").alias("line"),
        (F.col("o_orderkey") % 13 + 1).cast("int").alias("column"),
        F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("Type"), F.col("o_orderstatus"))).alias("enclosing_type"),
    )
    types = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("<C>"), (F.col("s_suppkey") - F.col("s_suppkey") % 6 + 3).cast("string")).alias("file_path"),
        F.col("s_suppkey").alias("pos"),
        F.col("s_name").alias("name"),
        F.element_at(F.array(F.lit("class"), F.lit("struct"), F.lit("actor")), F.col("s_nationkey") % 3 + 1).alias("type"),
        (F.col("s_nationkey") % 7).alias("lcom4"),
        (F.col("s_suppkey") % 10).cast("int").alias("method_count"),
        (F.col("s_nationkey") % 5).alias("property_count"),
        (F.col("s_suppkey") % 97 + 1).cast("int").alias("line"),
        (F.col("s_suppkey") % 13 + 1).cast("int").alias("column"),
    )
    return Analysis(files, functions, types.withColumn("cohesion_level", cohesion.cohesion_level(F.col("lcom4"))))


SHOP_FILES = "SELECT '<C>' || c_custkey AS file_path, c_custkey % 3 = 0 AS has_types FROM customer"
SHOP_FUNCTIONS = """
SELECT '<C>' || o_custkey AS file_path, o_orderkey AS pos, 'f' || (o_orderkey % 7) AS name, 'func f<T & ''' || o_orderpriority || '''>()' AS signature, o_orderpriority[1]::INT AS cyclomatic, day(o_orderdate)::INT AS cognitive,
       (o_orderkey % 97 + 1)::INT AS line, (o_orderkey % 13 + 1)::INT AS "column", CASE WHEN o_orderstatus <> 'O' THEN 'Type' || o_orderstatus END AS enclosing_type FROM orders"""
SHOP_TYPES = """
SELECT *, CASE WHEN lcom4 <= 1 THEN 'high' WHEN lcom4 = 2 THEN 'moderate' ELSE 'low' END AS cohesion_level FROM (
SELECT '<C>' || (s_suppkey - s_suppkey % 6 + 3) AS file_path, s_suppkey AS pos, s_name AS name, ['class', 'struct', 'actor'][s_nationkey % 3 + 1] AS type, (s_nationkey % 7)::INT AS lcom4,
       (s_suppkey % 10)::INT AS method_count, (s_nationkey % 5)::INT AS property_count, (s_suppkey % 97 + 1)::INT AS line, (s_suppkey % 13 + 1)::INT AS "column" FROM supplier)"""
SHOP_RULES = Rules((("TypeF", None, 12), (None, "P", 20)), 25)
SHOP_THRESHOLD = "CASE WHEN enclosing_type LIKE 'TypeF%' AND enclosing_type LIKE '%P' THEN 12 WHEN enclosing_type LIKE 'TypeF%' THEN 12 WHEN enclosing_type LIKE '%P' THEN 20 ELSE 25 END"
#: Files with the rows of their functions and types, as lists in order, and with their totals.
SHOP = f"""
WITH function AS ({SHOP_FUNCTIONS}), type AS ({SHOP_TYPES}), file AS ({SHOP_FILES}),
of_functions AS (SELECT file_path, list(f ORDER BY pos) AS functions, count(*) AS n, avg(cyclomatic) AS avg_cyclomatic, avg(cognitive) AS avg_cognitive, max(cyclomatic) AS max_cyclomatic, max(cognitive) AS max_cognitive, sum(cyclomatic)::BIGINT AS total_cyclomatic, sum(cognitive)::BIGINT AS total_cognitive FROM function f GROUP BY file_path),
of_types AS (SELECT file_path, list(t ORDER BY pos) AS types, count(*) AS n_types, avg(lcom4) AS avg_lcom4, max(lcom4) AS max_lcom4, count(*) FILTER (lcom4 >= 3) AS n_low FROM type t GROUP BY file_path),
shop AS (SELECT * FROM file LEFT JOIN of_functions USING (file_path) LEFT JOIN of_types USING (file_path))
"""


def text_sql(metrics: tuple[str, ...]) -> str:
    """The text report; ``metrics`` are the columns that it shows."""
    nl = "chr(10)"
    head = "| Function/Method      | " + " | ".join({"cyclomatic": "Cyclomatic", "cognitive": "Cognitive "}[m] for m in metrics) + " |"
    line = "+----------------------+" + "------------+" * len(metrics)
    cells = " || ' | ' || ".join(f"rpad(f.{m}::VARCHAR, 10, ' ')" for m in metrics)
    averages = " || ".join(f"', Average {m.capitalize()}: ' || printf('%.1f', avg_{m})" for m in metrics)
    classes = "| Class/Struct              | Type   | LCOM4 | Methods | Properties | Cohesion   |"
    rule = "+---------------------------+--------+-------+---------+------------+------------+"
    widths = (("name", 25), ("type", 6), ("lcom4", 5), ("method_count", 7), ("property_count", 10), ("cohesion_level", 10))
    row = " || ' | ' || ".join(f"rpad(t.{c}::VARCHAR, {w}, ' ')" for c, w in widths)
    return f"""{SHOP}
SELECT file_path, concat_ws({nl}, 'File: ' || file_path,
  CASE WHEN n > 0 THEN '{head}' || {nl} || '{line}' || {nl} || list_aggregate(list_transform(functions, lambda f: '| ' || rpad(f.name, 20, ' ') || ' | ' || {cells} || ' |' || {nl}), 'string_agg', '') || '{line}' || {nl} || 'Total: ' || n || ' functions' || {averages} || {nl} END,
  CASE WHEN has_types THEN 'Class Cohesion (LCOM4):' || {nl} || '{classes}' || {nl} || '{rule}' || {nl} || coalesce(list_aggregate(list_transform(types, lambda t: '| ' || {row} || ' |' || {nl}), 'string_agg', ''), '') || '{rule}' || {nl} ||
    'Total: ' || coalesce(n_types, 0) || ' classes, Average LCOM4: ' || printf('%.2f', coalesce(avg_lcom4, 0)) || ', Low cohesion: ' || coalesce(n_low, 0) || {nl} END) AS report
FROM shop WHERE n > 0 OR has_types"""


JSON_SQL = f"""{SHOP}
SELECT file_path, replace(replace(to_json({{
  'filePath': file_path,
  'functions': coalesce(list_transform(functions, lambda f: {{'name': f.name, 'signature': f.signature, 'cyclomaticComplexity': f.cyclomatic, 'cognitiveComplexity': f.cognitive, 'location': {{'line': f.line, 'column': f."column"}}, 'enclosingTypeName': f.enclosing_type}}), []),
  'summary': {{'totalFunctions': coalesce(n, 0), 'averageCyclomaticComplexity': coalesce(avg_cyclomatic, 0), 'averageCognitiveComplexity': coalesce(avg_cognitive, 0), 'maxCyclomaticComplexity': coalesce(max_cyclomatic, 0), 'maxCognitiveComplexity': coalesce(max_cognitive, 0), 'totalCyclomaticComplexity': coalesce(total_cyclomatic, 0), 'totalCognitiveComplexity': coalesce(total_cognitive, 0)}},
  'classCohesions': CASE WHEN has_types THEN coalesce(list_transform(types, lambda t: {{'name': t.name, 'type': t.type, 'lcom4': t.lcom4, 'methodCount': t.method_count, 'propertyCount': t.property_count, 'location': {{'line': t.line, 'column': t."column"}}}}), []) END,
  'cohesionSummary': CASE WHEN has_types THEN {{'totalClasses': coalesce(n_types, 0), 'averageLCOM4': coalesce(avg_lcom4, 0), 'maxLCOM4': coalesce(max_lcom4, 0), 'classesWithLowCohesion': coalesce(n_low, 0)}} END
}})::VARCHAR, ',"enclosingTypeName":null', ''), ',"classCohesions":null,"cohesionSummary":null', '') AS report FROM shop"""


def escaped_sql(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


def element_sql(name: str, value: str, last: bool = False) -> str:
    return f"'      <{name}>' || {value} || '</{name}>' || chr(10)"


XML_SQL = f"""{SHOP}
SELECT file_path, '  <file path="' || {escaped_sql("file_path")} || '">' || chr(10) || coalesce(list_aggregate(list_transform(functions, lambda f:
    '    <function name="' || f.name || '" signature="' || {escaped_sql("f.signature")} || '"' || coalesce(' enclosing-type="' || f.enclosing_type || '"', '') || ' line="' || f.line || '" column="' || f."column" || '">' || chr(10) ||
    {element_sql("cyclomatic-complexity", "f.cyclomatic")} || {element_sql("cognitive-complexity", "f.cognitive")} || '    </function>' || chr(10)), 'string_agg', '') ||
    '    <summary>' || chr(10) || {element_sql("total-functions", "n")} || {element_sql("average-cyclomatic-complexity", "avg_cyclomatic")} || {element_sql("average-cognitive-complexity", "avg_cognitive")} ||
    {element_sql("max-cyclomatic-complexity", "max_cyclomatic")} || {element_sql("max-cognitive-complexity", "max_cognitive")} || '    </summary>' || chr(10), '') ||
  CASE WHEN has_types THEN coalesce(list_aggregate(list_transform(types, lambda t:
    '    <class name="' || t.name || '" type="' || t.type || '" line="' || t.line || '" column="' || t."column" || '">' || chr(10) || {element_sql("lcom4", "t.lcom4")} || {element_sql("method-count", "t.method_count")} ||
    {element_sql("property-count", "t.property_count")} || {element_sql("cohesion-level", "t.cohesion_level")} || '    </class>' || chr(10)), 'string_agg', ''), '') ||
    '    <cohesion-summary>' || chr(10) || {element_sql("total-classes", "coalesce(n_types, 0)")} || {element_sql("average-lcom4", "coalesce(avg_lcom4, 0)")} || {element_sql("max-lcom4", "coalesce(max_lcom4, 0)")} ||
    {element_sql("low-cohesion-classes", "coalesce(n_low, 0)")} || '    </cohesion-summary>' || chr(10) ELSE '' END || '  </file>' || chr(10) AS report
FROM shop"""

DIAGNOSTIC_SQL = f"""
SELECT 0 AS section, file_path, pos, file_path || ':' || line || ':' || "column" || CASE WHEN greatest(cyclomatic, cognitive) > 2 * threshold THEN ': error: ' ELSE ': warning: ' END ||
       'Function ''' || name || ''' has high complexity (Cyclomatic: ' || cyclomatic || ', Cognitive: ' || cognitive || ', Threshold: ' || threshold || ')' AS message
FROM (SELECT *, {SHOP_THRESHOLD} AS threshold FROM ({SHOP_FUNCTIONS})) WHERE greatest(cyclomatic, cognitive) > threshold
UNION ALL
SELECT 1, file_path, pos, file_path || ':' || line || ':' || "column" || CASE WHEN lcom4 >= 5 THEN ': error: ' ELSE ': warning: ' END ||
       upper(type[1]) || type[2:] || ' ''' || name || ''' has low cohesion (LCOM4: ' || lcom4 || ', Level: ' || cohesion_level || ')' FROM ({SHOP_TYPES}) WHERE lcom4 >= 3"""

DESCRIPTION_SQL = f"""
SELECT 0 AS section, file_path, pos, name || ' - Cyclomatic: ' || cyclomatic || ', Cognitive: ' || cognitive || ' at ' || line || ':' || "column" AS text FROM ({SHOP_FUNCTIONS})
UNION ALL SELECT 1, file_path, pos, name || ' (' || type || '): LCOM4=' || lcom4 || ', cohesion=' || cohesion_level FROM ({SHOP_TYPES})
UNION ALL SELECT 2, file_path, 0, concat_ws(chr(10), 'Cohesion Summary:', '  Total classes: ' || count(*), '  Average LCOM4: ' || printf('%.2f', avg(lcom4)), '  Max LCOM4: ' || max(lcom4), '  Low cohesion classes: ' || count(*) FILTER (lcom4 >= 3)) FROM ({SHOP_TYPES}) GROUP BY file_path"""

FILTERED_SQL = f"""
WITH kept AS (SELECT * FROM ({SHOP_FUNCTIONS}) WHERE greatest(cyclomatic, cognitive) >= {SHOP_THRESHOLD}), chosen AS (
  SELECT false AS all_types, file_path, lcom4 FROM ({SHOP_TYPES}) WHERE lcom4 >= 3 UNION ALL SELECT true, file_path, lcom4 FROM ({SHOP_TYPES})
), wanted AS (
  SELECT DISTINCT all_types, file_path FROM (SELECT all_types, file_path FROM chosen UNION ALL SELECT false, file_path FROM kept UNION ALL SELECT true, file_path FROM kept) SEMI JOIN ({SHOP_FILES}) USING (file_path)
)
SELECT file_path, all_types, coalesce((SELECT count(*) FROM kept k WHERE k.file_path = w.file_path), 0) AS total_functions, coalesce((SELECT sum(cognitive) FROM kept k WHERE k.file_path = w.file_path), 0)::BIGINT AS total_cognitive,
       coalesce((SELECT count(*) FROM chosen c WHERE c.file_path = w.file_path AND c.all_types = w.all_types), 0) AS total_classes
FROM wanted w"""

EXIT_SQL = f"""
SELECT 'rules' AS asked, bool_or(greatest(cyclomatic, cognitive) >= {SHOP_THRESHOLD}) AS exceeded FROM ({SHOP_FUNCTIONS})
UNION ALL SELECT 'thirty-one', bool_or(greatest(cyclomatic, cognitive) >= 31) FROM ({SHOP_FUNCTIONS})
UNION ALL SELECT 'thirty-two', bool_or(greatest(cyclomatic, cognitive) >= 32) FROM ({SHOP_FUNCTIONS})
UNION ALL SELECT 'nothing', false UNION ALL SELECT 'no rules', false"""

AGAIN_SQL = f"""
SELECT file_path, (row_number() OVER (PARTITION BY file_path ORDER BY pos) - 1)::INT AS pos, name, cyclomatic, cognitive, line, "column" AS col, enclosing_type AS kind FROM ({SHOP_FUNCTIONS}) SEMI JOIN ({SHOP_FILES}) USING (file_path)
UNION ALL
SELECT file_path, (-row_number() OVER (PARTITION BY file_path ORDER BY pos))::INT, name, lcom4, method_count, line, "column", type FROM ({SHOP_TYPES}) SEMI JOIN (SELECT * FROM ({SHOP_FILES}) WHERE has_types) USING (file_path)"""


def text_report(spark, sf_dir):
    return report_rows(shop_analysis(spark, sf_dir), "text")


def text_report_of_one_metric(spark, sf_dir):
    return report_rows(shop_analysis(spark, sf_dir), "text", metrics="cognitive")


def json_report(spark, sf_dir):
    return report_rows(shop_analysis(spark, sf_dir), "json")


def xml_report(spark, sf_dir):
    return report_rows(shop_analysis(spark, sf_dir), "xml")


def diagnostic_report(spark, sf_dir):
    return report_rows(shop_analysis(spark, sf_dir), "xcode", rules=SHOP_RULES)


def descriptions(spark, sf_dir):
    return described(shop_analysis(spark, sf_dir))


def filtered_results(spark, sf_dir):
    """What is left of every file after a filter, with its types of low cohesion and with all of them."""
    out = None
    for keep in (False, True):
        left = shop_analysis(spark, sf_dir).filtered(SHOP_RULES, keep_all_cohesions=keep)
        totals = left.summary.join(left.cohesion_summary, "file_path", "left").select("file_path", F.lit(keep).alias("all_types"), "total_functions", "total_cognitive", F.coalesce("total_classes", F.lit(0)).alias("total_classes"))
        out = totals if out is None else out.unionByName(totals)
    return out


def exit_status(spark, sf_dir):
    result = shop_analysis(spark, sf_dir)
    asked = [("rules", SHOP_RULES, None), ("thirty-one", None, 31), ("thirty-two", None, 32), ("nothing", None, None), ("no rules", Rules(), None)]
    return spark.createDataFrame([(name, result.exceeded(rules, threshold)) for name, rules, threshold in asked], "asked string, exceeded boolean")


def results_read_again(spark, sf_dir):
    """Functions and types of JSON reports that have been read again."""
    reports = report_rows(shop_analysis(spark, sf_dir), "json").select(F.concat(F.lit('{"files":['), F.col("report"), F.lit("]}")).alias("value"))
    again = read_results(spark, reports)
    functions = again.functions.select("file_path", "pos", "name", "cyclomatic", "cognitive", "line", F.col("column").alias("col"), F.col("enclosing_type").alias("kind"))
    types = again.cohesions.select("file_path", (-1 - F.col("pos")).alias("pos"), "name", F.col("lcom4").alias("cyclomatic"), F.col("method_count").alias("cognitive"), "line", F.col("column").alias("col"), F.col("type").alias("kind"))
    return functions.unionByName(types)


# ---- on sources


def values(rows, columns: str) -> str:
    """Rows as a table of constants."""

    def constant(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(constant, r)) + ")" for r in rows) + f") AS v({columns})"


def wrapped(bodies) -> dict[str, str]:
    return {f"case {i}": f"func f() {{\n{body}\n}}" for i, body in enumerate(bodies)}


def plain(rows: DataFrame) -> DataFrame:
    """Without the position, and without a name that SQL reserves."""
    return rows.drop("pos").withColumnRenamed("column", "col")


def outermost(functions: DataFrame) -> DataFrame:
    return functions.where("name = 'f'").select("file_path", "cyclomatic", "cognitive")


def function_complexity(spark, sf_dir):
    return plain(batch_analyze(spark, samples.SOURCES).functions)


def metric_rules(spark, sf_dir):
    return outermost(batch_analyze(spark, wrapped(c[0] for c in rule_cases.METRICS)).functions)


def folded_rules(spark, sf_dir):
    return outermost(analyze_sources(strings(spark, wrapped(c[0] for c in rule_cases.FOLDED)), fold_operators=True).functions)


def declarations(spark, sf_dir):
    sources = {f"case {i}": code for i, (code, _) in enumerate(rule_cases.DECLARATIONS)}
    return batch_analyze(spark, sources).functions.select("file_path", "name", "signature", "line", F.col("column").alias("col"), "enclosing_type")


def snippets(spark, sf_dir):
    """Summaries of one text and of an empty one."""
    one, none = analyze_code(spark, "func f() { if a { } }\nfunc g() { }"), analyze_code(spark, "", "empty")
    return one.summary.unionByName(none.summary)


def type_cohesion(spark, sf_dir):
    return plain(analyze_sources(strings(spark, samples.SOURCES), "syntax").cohesions)


def index_cohesion(spark, sf_dir):
    symbols = spark.createDataFrame(samples.SYMBOLS, "usr string, name string, kind string, parent_usr string")
    occurrences = spark.createDataFrame(samples.OCCURRENCES, "usr string, role string, container_usr string")
    return plain(analyze_sources(strings(spark, samples.SOURCES), "index", symbols, occurrences).cohesions)


def member_rules(spark, sf_dir):
    sources = {f"case {i}": f"class C {{\n{members}\n}}" for i, (members, *_) in enumerate(rule_cases.MEMBERS)}
    return analyze_sources(strings(spark, sources), "syntax").cohesions.select("file_path", "lcom4", "method_count", "property_count", "cohesion_level")


def level(lcom4: int) -> str:
    return "high" if lcom4 <= 1 else "moderate" if lcom4 == 2 else "low"


def type_values(place: int) -> str:
    rows = [(*t[:3], t[place], *t[5:], level(t[place])) for t in rule_cases.TYPES]
    return values(rows, 'file_path, name, type, lcom4, method_count, property_count, line, col, cohesion_level')


#: Files that come with the package: a tree of sources and a rule file.
EXAMPLES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "examples")


def listed_files(spark, sf_dir):
    """Listings of the example tree: alone, with what lies below, without tests or parts, and of overlapping paths."""
    top = f"{EXAMPLES}/Shop"
    asked = {
        "alone": ([top], {}),
        "below": ([top], {"recursive": True}),
        "no tests": ([top], {"recursive": True, "exclude": ["Tests/"]}),
        "no parts": ([top], {"recursive": True, "exclude_globs": ["*/Parts/*"]}),
        "overlap": ([f"{top}/Cart.swift", f"{top}/notes.txt", top], {}),
    }
    rows = [(name, place, f.removeprefix(f"{top}/")) for name, (paths, more) in asked.items() for place, f in enumerate(collect_files(spark, paths, **more))]
    return spark.createDataFrame(rows, "asked string, place int, file string")


def listed_rows() -> list[tuple]:
    every, alone = [n for n, _ in rule_cases.LISTED], [n for n, a in rule_cases.LISTED if a]
    found = {"alone": alone, "below": every, "no tests": [n for n in every if "Tests/" not in n], "no parts": [n for n in every if "Parts/" not in n], "overlap": alone}
    return [(name, place, n) for name, names in found.items() for place, n in enumerate(names)]


def analyzed_files(spark, sf_dir):
    """Files from disk, read and measured."""
    functions = plain(analyze(spark, [f"{EXAMPLES}/Shop"], recursive=True, exclude=["Tests"]).functions)
    return functions.withColumn("file_path", F.replace("file_path", F.lit(f"{EXAMPLES}/Shop/"), F.lit("")))


def analyzed_rows() -> list[tuple]:
    home = {"Sources/Shop/Cart.swift": "Cart.swift", "Sources/Shop/Rules.swift": "Parts/Rules.swift", "Sources/Shop/Store.swift": ".Store.swift"}
    return [(home[f[0]], *f[1:]) for f in rule_cases.FUNCTIONS]


def rule_file(spark, sf_dir):
    """The rules of a folder and, without prefix and suffix, its default."""
    rules = rules_for(None, EXAMPLES)
    return spark.createDataFrame([*rules.rules, (None, None, rules.default)], "prefix string, suffix string, threshold int")


def rule_thresholds(spark, sf_dir):
    """Thresholds of types by the rules of a folder, without and with a fallback."""
    rules = rules_for(None, EXAMPLES)
    names = spark.createDataFrame([(n[0],) for n in rule_cases.NAMES], "enclosing_type string")
    out = thresholds.with_threshold(names, rules.frame(spark), None, rules.default).withColumnRenamed("threshold", "own")
    return thresholds.with_threshold(out, rules.frame(spark), 3, rules.default).withColumnRenamed("threshold", "with_fallback")


def tool_answers(spark, sf_dir):
    """What tools answer to right and wrong arguments: whether it is an error, and how many functions it tells of."""
    top = f"{EXAMPLES}/Shop"
    asked = {
        "paths": ("analyze_complexity", {"paths": [top], "recursive": True, "exclude": ["Tests"]}),
        "wrong types": ("analyze_complexity", {"paths": [top, 7], "recursive": "yes", "threshold": "9", "exclude": "Cart"}),
        "threshold": ("analyze_complexity", {"paths": [top], "recursive": True, "threshold": 5}),
        "rule file": ("analyze_complexity", {"paths": [top], "recursive": True, "config_path": f"{EXAMPLES}/.sparkgauge.yml"}),
        "code": ("analyze_code_string", {"code": "func f() { if a { } }"}),
        "empty code": ("analyze_code_string", {"code": "", "file_name": "x"}),
        "no code": ("analyze_code_string", {"code": 5}),
        "no paths": ("analyze_complexity", None),
        "empty paths": ("analyze_complexity", {"paths": []}),
        "missing path": ("analyze_complexity", {"paths": [f"{top}/none"]}),
        "no sources": ("analyze_complexity", {"paths": [f"{top}/notes.txt"]}),
        "both metrics": ("analyze_complexity", {"paths": [top], "cyclomatic_only": True, "cognitive_only": True}),
        "no index": ("analyze_complexity", {"paths": [top], "lcom4": True}),
        "no rule file": ("analyze_complexity", {"paths": [top], "config_path": f"{top}/none.yml"}),
        "no such tool": ("other", {}),
    }
    rows = []
    for name, (tool, arguments) in asked.items():
        found = service.call_tool(spark, tool, arguments)
        rows.append((name, found.is_error, None if found.is_error else sum(len(f["functions"]) for f in json.loads(found.text)["files"])))
    return spark.createDataFrame(rows, "asked string, is_error boolean, n_functions int")


def web_answers(spark, sf_dir):
    """What web requests answer: raw results by path, and reports in other formats."""
    one, two = "func b() { if x { } }", "struct S { func a() { } }"
    raw = service.analyze_response(spark, {"code": one, "fileName": "one"})["result"]
    both = service.batch_response(spark, {"files": [{"code": two, "path": "two"}, {"code": one, "path": "one"}]})["results"]
    text = service.analyze_response(spark, {"code": one, "fileName": "one", "format": "text", "showCognitiveOnly": True})["formatted"]
    again = service.format_response(spark, {"results": both, "format": "xcode", "threshold": 1})["formatted"]
    rows = [("raw", json.dumps(raw, sort_keys=True)), ("batch", ",".join(r["filePath"] for r in both)), ("text", text), ("xcode", again)]
    return spark.createDataFrame(rows, "asked string, answer string")


WEB_ANSWERS = [
    (
        "raw",
        '{"filePath": "one", "functions": [{"cognitiveComplexity": 1, "cyclomaticComplexity": 2, "location": {"column": 1, "line": 1}, "name": "b", "signature": "func b()"}], '
        '"summary": {"averageCognitiveComplexity": 1.0, "averageCyclomaticComplexity": 2.0, "maxCognitiveComplexity": 1, "maxCyclomaticComplexity": 2, "totalCognitiveComplexity": 1, "totalCyclomaticComplexity": 2, "totalFunctions": 1}}',
    ),
    ("batch", "one,two"),
    (
        "text",
        "File: one\n| Function/Method      | Cognitive  |\n+----------------------+------------+\n| b                    | 1          |\n+----------------------+------------+\nTotal: 1 functions, Average Cognitive: 1.0",
    ),
    ("xcode", "one:1:1: warning: Function 'b' has high complexity (Cyclomatic: 2, Cognitive: 1, Threshold: 1)\n"),
]


def environment_thresholds(spark, sf_dir):
    """The threshold that the environment asks for, under a name of its own."""
    name, rows = "SPARKGAUGE_THRESHOLD_OF_QUERY", []
    for value in (None, "7", "many"):
        os.environ.pop(name, None)
        if value is not None:
            os.environ[name] = value
        rows += [(value, default, env_threshold(default, name)) for default in (10, 4)]
    os.environ.pop(name, None)
    return spark.createDataFrame(rows, "value string, otherwise int, threshold int")


FUNCTION_COLUMNS = 'file_path, name, signature, cyclomatic, cognitive, line, col, enclosing_type'

SUMMARY = """count(pos) AS total_functions, coalesce(avg(cyclomatic), 0) AS avg_cyclomatic, coalesce(avg(cognitive), 0) AS avg_cognitive,
       coalesce(max(cyclomatic), 0)::INT AS max_cyclomatic, coalesce(max(cognitive), 0)::INT AS max_cognitive,
       coalesce(sum(cyclomatic), 0)::BIGINT AS total_cyclomatic, coalesce(sum(cognitive), 0)::BIGINT AS total_cognitive"""

def ordered_report(spark, sf_dir):
    """The lines of a JSON report in files, as they follow each other."""
    path = new_path(spark, "report")
    write_report(shop_analysis(spark, sf_dir), path, "json")
    return read_lines(spark, path)


#: The file's line, its functions, the summary, its types and their totals.
ORDERED_SQL = f"""{SHOP}, line AS (
  SELECT 1 AS part, file_path, 0 AS section, 0 AS pos, CASE WHEN file_path = (SELECT min(file_path) FROM shop) THEN '' ELSE ',' END || '{{"filePath":"' || file_path || '","functions":[' AS line FROM shop
  UNION ALL SELECT 1, file_path, 2, pos, CASE WHEN pos = min(pos) OVER (PARTITION BY file_path) THEN '' ELSE ',' END || '{{"name":"' || name || '","signature":"' || signature || '","cyclomaticComplexity":' || cyclomatic || ',"cognitiveComplexity":' || cognitive || ',"location":{{"line":' || line || ',"column":' || "column" || '}}' || coalesce(',"enclosingTypeName":"' || enclosing_type || '"', '') || '}}' FROM function
  UNION ALL SELECT 1, file_path, 3, 0, '],"summary":' || to_json({{'totalFunctions': coalesce(n, 0), 'averageCyclomaticComplexity': coalesce(avg_cyclomatic, 0), 'averageCognitiveComplexity': coalesce(avg_cognitive, 0), 'maxCyclomaticComplexity': coalesce(max_cyclomatic, 0), 'maxCognitiveComplexity': coalesce(max_cognitive, 0), 'totalCyclomaticComplexity': coalesce(total_cyclomatic, 0), 'totalCognitiveComplexity': coalesce(total_cognitive, 0)}})::VARCHAR || CASE WHEN has_types THEN ',"classCohesions":[' ELSE '}}' END FROM shop
  UNION ALL SELECT 1, file_path, 5, pos, CASE WHEN pos = min(pos) OVER (PARTITION BY file_path) THEN '' ELSE ',' END || '{{"name":"' || name || '","type":"' || type || '","lcom4":' || lcom4 || ',"methodCount":' || method_count || ',"propertyCount":' || property_count || ',"location":{{"line":' || line || ',"column":' || "column" || '}}}}' FROM type WHERE file_path IN (SELECT file_path FROM file WHERE has_types)
  UNION ALL SELECT 1, file_path, 6, 0, '],"cohesionSummary":' || to_json({{'totalClasses': coalesce(n_types, 0), 'averageLCOM4': coalesce(avg_lcom4, 0), 'maxLCOM4': coalesce(max_lcom4, 0), 'classesWithLowCohesion': coalesce(n_low, 0)}})::VARCHAR || '}}' FROM shop WHERE has_types
  UNION ALL SELECT 0, '', 0, 0, '{{"files":['
  UNION ALL SELECT 2, '', 0, 0, ']}}'
)
SELECT row_number() OVER (ORDER BY part, file_path, section, pos) AS place, line FROM line"""

WITH_ORACLE = {
    file_summary: f"SELECT c_custkey AS file_path, {SUMMARY} FROM customer LEFT JOIN ({ORDER_FUNCTIONS}) ON file_path = c_custkey GROUP BY c_custkey",
    strictest_threshold: f"SELECT p_partkey, enclosing_type, threshold FROM ({PART_FUNCTIONS})",
    exceeded_functions: f"SELECT p_partkey, cyclomatic, cognitive, threshold FROM ({PART_FUNCTIONS}) WHERE greatest(cyclomatic, cognitive) >= threshold",
    any_exceeded: f"SELECT coalesce(bool_or(greatest(cyclomatic, cognitive) >= threshold), false) AS exceeded FROM ({PART_FUNCTIONS})",
    file_filter_recompute: f"SELECT file_path, {SUMMARY} FROM (SELECT l_orderkey AS file_path, l_linenumber AS pos, trunc(l_quantity)::INT AS cyclomatic, l_linenumber AS cognitive FROM lineitem) WHERE greatest(cyclomatic, cognitive) >= 40 GROUP BY file_path",
    bands: """
SELECT p_partkey, CASE WHEN p_size > 10 THEN 'red' WHEN p_size > 5 THEN 'yellow' ELSE 'green' END AS ui_band,
       CASE WHEN p_size <= 10 THEN 'low' WHEN p_size <= 20 THEN 'moderate' WHEN p_size <= 50 THEN 'high' ELSE 'very high' END AS risk_band,
       CASE WHEN p_size <= 5 THEN 'low' WHEN p_size <= 10 THEN 'moderate' WHEN p_size <= 15 THEN 'high' WHEN p_size <= 25 THEN 'very high' ELSE 'extreme' END AS cognitive_band FROM part""",
    component_count: COMPONENTS,
    cohesion_level_summary: f"""
SELECT c_nationkey AS file_path, count(*) AS total_classes, avg(components) AS avg_lcom4, max(components) AS max_lcom4, count(*) FILTER (components >= 3) AS low_classes,
       count(*) FILTER (components <= 1) AS n_high, count(*) FILTER (components = 2) AS n_moderate
FROM ({COMPONENTS}) JOIN customer ON c_custkey = type_pos GROUP BY c_nationkey""",
    logical_runs: """
SELECT user_id, sum(CASE WHEN logical AND before THEN 1 ELSE 0 END)::BIGINT AS extra
FROM (SELECT user_id, logical, lag(logical, 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, event_type IN ('click', 'view') AS logical FROM events)) GROUP BY user_id""",
    exclude_regex: r"SELECT page_id, url FROM pages WHERE NOT (regexp_matches(url, '/de/') OR regexp_matches(url, '[?]utm_') OR regexp_matches(url, '\.org/'))",
    xml_escape: """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM pages""",
    text_row_pad: "SELECT p_brand, p_type, rpad(p_type, 20, ' ') || '|' || rpad(sum(p_size)::VARCHAR, 10, ' ') || '|' || printf('%.1f', sum(p_size) / count(*)) || '|' || printf('%.2f', sum(p_size) / count(*)) AS line FROM part GROUP BY p_brand, p_type",
    trimmed_text: r"SELECT conv_id, turn, length(trim(chr(32) || chr(9) || chr(10) || text || chr(10) || chr(9) || chr(32) || chr(13), chr(32) || chr(9) || chr(10) || chr(13)))::BIGINT AS n FROM conversations",
    cognitive_points: """
SELECT user_id, (1 + count(*) FILTER (event_type IN ('view', 'click', 'purchase')))::BIGINT AS cyclomatic,
       sum(CASE event_type WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 1 ELSE 1 + floor(value) % 4 END WHEN 'click' THEN 1 + floor(value) % 4 WHEN 'signup' THEN 1 + floor(value) % 4 WHEN 'purchase' THEN 1 ELSE 0 END)::BIGINT AS cognitive
FROM events GROUP BY user_id""",
    member_counts: "SELECT l_orderkey AS type_pos, method_count::INT AS method_count, property_count::INT AS property_count FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS method_count, count(*) FILTER (l_linestatus = 'O' AND l_tax > 0.04) AS property_count FROM lineitem GROUP BY l_orderkey) WHERE method_count + property_count > 0",
    first_symbol: "SELECT name, kind, min(p_partkey) AS parent_usr FROM (SELECT p_partkey, p_brand || '/' || p_type AS name, CASE WHEN p_size % 2 = 0 THEN 'class' WHEN p_size % 3 = 0 THEN 'struct' END AS kind FROM part) WHERE kind IS NOT NULL GROUP BY name, kind",
    method_accesses: "SELECT DISTINCT o_custkey AS type_pos, o_orderkey::VARCHAR AS id, 'p' || l_partkey AS property FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 25",
    lcom4_of_shop: LCOM4_OF_SHOP,
    chosen_paths: "SELECT DISTINCT url AS file_path FROM pages WHERE (url LIKE 'https:%' OR url LIKE '%/en/%') AND url NOT LIKE '%/de/%' AND url NOT LIKE '%7' AND NOT contains(url, '?')",
    text_report: text_sql(("cyclomatic", "cognitive")),
    text_report_of_one_metric: text_sql(("cognitive",)),
    json_report: JSON_SQL,
    xml_report: XML_SQL,
    diagnostic_report: DIAGNOSTIC_SQL,
    descriptions: DESCRIPTION_SQL,
    filtered_results: FILTERED_SQL,
    exit_status: EXIT_SQL,
    results_read_again: AGAIN_SQL,
    ordered_report: ORDERED_SQL,
}

#: What runs on sources and requests of its own, not on the given tables: cases for tests, with the rows that the rules give by hand.
CASES = {
    function_complexity: values(rule_cases.FUNCTIONS, FUNCTION_COLUMNS),
    metric_rules: values([(f"case {i}", *c[1:]) for i, c in enumerate(rule_cases.METRICS)], "file_path, cyclomatic, cognitive"),
    folded_rules: values([(f"case {i}", *c[1:]) for i, c in enumerate(rule_cases.FOLDED)], "file_path, cyclomatic, cognitive"),
    declarations: values([(f"case {i}", *r) for i, (_, rows) in enumerate(rule_cases.DECLARATIONS) for r in rows], 'file_path, name, signature, line, col, enclosing_type'),
    snippets: "SELECT '<stdin>' AS file_path, 2::BIGINT AS total_functions, 1.5::DOUBLE AS avg_cyclomatic, 0.5::DOUBLE AS avg_cognitive, 2 AS max_cyclomatic, 1 AS max_cognitive, 3::BIGINT AS total_cyclomatic, 1::BIGINT AS total_cognitive UNION ALL SELECT 'empty', 0, 0, 0, 0, 0, 0, 0",
    type_cohesion: type_values(3),
    index_cohesion: type_values(4),
    member_rules: values([(f"case {i}", *m[1:], level(m[1])) for i, m in enumerate(rule_cases.MEMBERS)], "file_path, lcom4, method_count, property_count, cohesion_level"),
    listed_files: values(listed_rows(), "asked, place, file"),
    analyzed_files: values(analyzed_rows(), FUNCTION_COLUMNS),
    rule_file: values(rule_cases.RULES, "prefix, suffix, threshold"),
    rule_thresholds: values(rule_cases.NAMES, "enclosing_type, own, with_fallback"),
    tool_answers: values(rule_cases.TOOL_ANSWERS, "asked, is_error, n_functions"),
    web_answers: values(WEB_ANSWERS, "asked, answer"),
    environment_thresholds: values([(None, 10, 10), (None, 4, 4), ("7", 10, 7), ("7", 4, 7), ("many", 10, 10), ("many", 4, 4)], "value, otherwise, threshold"),
}

WITH_ORACLE |= ON_TABLES

QUERIES = {f.__name__: f for f in WITH_ORACLE}
ORACLES = {f.__name__: sql for f, sql in WITH_ORACLE.items()}
