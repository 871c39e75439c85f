"""Queries that put scans, metrics and cohesion on the test tables, with the same in DuckDB's SQL.

The tables hold no source code: syntax rows, symbols and source texts are made of their columns by
expressions, so that all of it grows with them, and every rule has its say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import brackets, cohesion, components, containment, metrics, thresholds
from .plans.analysis import analyze_sources
from .plans.symbol_index import SymbolIndex
from .sources.storage import new_path, partitions
from .sources.tree import read_tree
from .streaming.summaries import follow
from .streaming.summaries import summaries as followed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros() -> Column:
    """Microseconds of an event since the first day, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")


# ---- spans and what they hold


def signups(spark, sf_dir):
    """Events as places, and a span for every sign-up that is as many hours long as its value says."""
    places = table(spark, sf_dir, "events").select("event_id", "user_id", micros().alias("at"))
    spans = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_id").alias("span_id"), "user_id", micros().alias("opens"), (micros() + F.floor("value") * 3_600_000_000).alias("closes"))
    return places, spans


SIGNUPS = """
WITH place AS (
  SELECT event_id, user_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS moment FROM events
), span AS (
  SELECT event_id AS span_id, user_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS opens, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') + floor(value)::BIGINT * 3600000000 AS closes FROM events WHERE event_type = 'signup'
), held AS (
  SELECT event_id, span_id, opens, closes FROM place JOIN span USING (user_id) WHERE moment BETWEEN opens AND closes
)
"""
SPAN = (["user_id"], "at", "opens", "closes", "span_id")


def span_containers(spark, sf_dir):
    return containment.containers(*signups(spark, sf_dir), *SPAN).select("event_id", "span.span_id")


def nearest_spans(spark, sf_dir):
    return containment.nearest_container(*signups(spark, sf_dir), *SPAN).select("event_id", "span.span_id", "span.opens")


# ---- brackets


def bracket_tokens(spark, sf_dir):
    """Capital letters and parentheses open, ends of sentences and parentheses close; commas are logical operators, other marks are not."""
    marks = F.expr(r"regexp_extract_all(coalesce(text, ''), '([A-Z().!?,;:-])', 1)")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(marks).alias("at", "mark"))
    mark = F.col("mark")
    kind = F.when(mark.rlike("[A-Z(]"), brackets.OPEN).when(mark.rlike("[).!?]"), brackets.CLOSE).when(mark == ",", brackets.LOGICAL).otherwise(brackets.OTHER)
    return rows.select("doc_id", F.col("at").cast("long").alias("at"), kind.alias("kind"))


def bracket_runs(spark, sf_dir):
    return brackets.matched(bracket_tokens(spark, sf_dir), ["doc_id"]).select("doc_id", F.col("at").alias("place"), "depth", "partner", "scope", "continued")


BRACKETS = r"""
WITH mark AS (
  SELECT doc_id, unnest(m) AS c, generate_subscripts(m, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Z().!?,;:-]') AS m FROM documents)
), token AS (
  SELECT doc_id, i, c = ',' AS logical, CASE WHEN regexp_matches(c, '[A-Z(]') THEN 1 WHEN regexp_matches(c, '[).!?]') THEN -1 ELSE 0 END AS up FROM mark
), summed AS (
  SELECT *, sum(up) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM token
), levelled AS (
  SELECT *, s + (up = -1)::INT AS level, least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS low FROM summed
), met AS (
  SELECT *, last_value(CASE WHEN up <> 0 THEN i END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         first_value(CASE WHEN up <> 0 THEN i END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
         last_value(CASE WHEN up = 0 THEN i END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS operator,
         last_value(CASE WHEN up = 0 THEN logical END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was_logical
  FROM levelled WINDOW w AS (PARTITION BY doc_id, level ORDER BY i)
)
SELECT doc_id, i::BIGINT AS place, (s - (up = 1)::INT - low)::BIGINT AS depth, (CASE up WHEN 1 THEN after WHEN -1 THEN before END)::BIGINT AS partner, (CASE up WHEN 0 THEN before END)::BIGINT AS scope,
       logical AND operator IS NOT NULL AND (before IS NULL OR operator > before) AND was_logical AS continued
FROM met
"""


# ---- components


#: Rows of a graph that one task takes in ``status_components``; its graphs are the three states of orders.
TASK = 1000


def status_components(spark, sf_dir):
    """Orders of a state, linked by the parts of which they hold many: a few graphs that each outgrow a task."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"))
    name = F.concat(F.lit("o"), F.col("key").cast("string"))
    many = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("key"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return components.count_components(orders.select("status", name.alias("name")), orders.join(many, "key").select("status", name.alias("src"), "dst"), ["status"], TASK)


STATUS_COMPONENTS = """
WITH RECURSIVE link AS (
  SELECT DISTINCT o_orderstatus AS status, 'o' || l_orderkey AS x, 'p' || l_partkey AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 45
), edge AS (
  SELECT status, x, y FROM link UNION SELECT status, y, x FROM link
), label(status, node, low) USING KEY (status, node) AS (
  SELECT DISTINCT status, x, x FROM edge
  UNION
  SELECT e.status, e.x, min(l.low) FROM label l JOIN edge e ON e.status = l.status AND e.y = l.node JOIN recurring.label r ON r.status = e.status AND r.node = e.x GROUP BY e.status, e.x HAVING min(l.low) < any_value(r.low)
)
SELECT o_orderstatus AS status, count(DISTINCT coalesce(low, 'o' || o_orderkey)) AS components
FROM orders LEFT JOIN label ON label.status = o_orderstatus AND node = 'o' || o_orderkey GROUP BY o_orderstatus
"""


# ---- many rules


def part_name() -> Column:
    return F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))


def part_rules(spark, sf_dir) -> DataFrame:
    """A rule for every part: beginnings and ends of its name, one or both."""
    key, name = F.col("p_partkey"), part_name()
    prefix = F.when(key % 4 < 3, F.substring(name, F.lit(1), (F.lit(6) + key % 9).cast("int")))
    suffix = F.when(key % 4 > 0, F.right(name, (F.lit(2) + key % 3).cast("int")))
    return table(spark, sf_dir, "part").select(prefix.alias("prefix"), suffix.alias("suffix"), (key % 89 + 1).cast("int").alias("threshold"))


def name_thresholds(spark, sf_dir):
    """Names of parts against as many rules."""
    names = table(spark, sf_dir, "part").select("p_partkey", part_name().alias("enclosing_type"))
    return thresholds.with_threshold(names, part_rules(spark, sf_dir), None, 99).select("p_partkey", "threshold")


NAME_THRESHOLDS = """
WITH named AS (
  SELECT p_partkey, p_name || ' ' || p_partkey AS name FROM part
), rule AS (
  SELECT CASE WHEN p_partkey % 4 < 3 THEN left(name, 6 + p_partkey % 9) END AS prefix, CASE WHEN p_partkey % 4 > 0 THEN right(name, 2 + p_partkey % 3) END AS suffix, p_partkey % 89 + 1 AS threshold FROM named
), least AS (
  SELECT prefix, suffix, min(threshold) AS threshold FROM rule GROUP BY prefix, suffix
)
SELECT p_partkey, coalesce(min(threshold), 99)::INT AS threshold
FROM named LEFT JOIN least ON (prefix IS NULL OR starts_with(name, prefix)) AND (suffix IS NULL OR ends_with(name, suffix)) GROUP BY p_partkey
"""


# ---- metrics of syntax rows

#: Kind and operator of an event's node, by its id.
NODES = [("if", None), ("if", None), ("else", None), ("guard", None), ("while", None), ("for", None), ("repeat", None), ("switch", None), ("case", None), ("catch", None), ("ternary", None), ("binop", "&&"), ("binop", "||"), ("binop", "&&"), ("binop", "+"), ("binop", "??"), ("break", None)]


def event_syntax(spark, sf_dir):
    """A file for each user with three functions, each with one inside; events are nodes of both, at depths and in runs of their own."""
    node = F.get(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(o).cast("string").alias("name")) for k, o in NODES)), (F.col("event_id") % len(NODES)).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("file_path"), F.col("event_id").cast("int").alias("pos"), (F.col("event_id") % 3).cast("int").alias("k"), "event_id", "value", node.alias("node"))
    whole = lambda c: c.cast("int")
    nodes = rows.select(
        "file_path",
        F.lit("node").alias("row"),
        "pos",
        "node.kind",
        "node.name",
        (F.col("event_id") % len(NODES) == 1).alias("is_else_if"),
        F.array("k", F.col("k") + 100).alias("fns"),
        F.array(whole(F.floor("value") % 6 - 1), whole(F.floor(F.col("value") * 3) % 5 - 1)).alias("depths"),
        F.array(whole(F.floor("value") % 3), whole(F.floor(F.col("value") * 7) % 2)).alias("runs"),
    )
    functions = rows.select("file_path", F.explode(F.array("k", F.col("k") + 100)).alias("pos")).distinct()
    functions = functions.select("file_path", F.lit("function").alias("row"), "pos", F.concat(F.lit("f"), F.col("pos").cast("string")).alias("name"), F.lit("func f()").alias("signature"), F.col("pos").alias("line"), F.lit(1).alias("column"), F.when(F.col("pos") >= 100, "Inner").alias("enclosing"))
    return nodes.unionByName(functions, allowMissingColumns=True)


def measured(spark, sf_dir, fold_operators: bool) -> DataFrame:
    return metrics.function_metrics(event_syntax(spark, sf_dir), fold_operators).select("file_path", "pos", "name", "cyclomatic", "cognitive", "enclosing_type")


def event_metrics(spark, sf_dir):
    return measured(spark, sf_dir, False)


def folded_event_metrics(spark, sf_dir):
    return measured(spark, sf_dir, True)


def metrics_sql(fold: bool) -> str:
    kinds = ", ".join(f"'{k}'" for k, _ in NODES)
    names = ", ".join("NULL" if o is None else f"'{o}'" for _, o in NODES)
    folded = "OR kind = 'ternary' OR coalesce(name = '??', false)" if fold else ""
    return f"""
WITH node AS (
  SELECT 'user ' || user_id AS file_path, event_id AS pos, event_id % 3 AS k, value, event_id % {len(NODES)} = 1 AS else_if, [{kinds}][event_id % {len(NODES)} + 1] AS kind, [{names}][event_id % {len(NODES)} + 1] AS name FROM events
), inside AS (
  SELECT file_path, pos, k AS fn, kind, name, else_if, floor(value)::BIGINT % 6 - 1 AS depth, floor(value)::BIGINT % 3 AS run FROM node
  UNION ALL SELECT file_path, pos, k + 100, kind, name, else_if, floor(value * 3)::BIGINT % 5 - 1, floor(value * 7)::BIGINT % 2 FROM node
), operator AS (
  SELECT file_path, fn, (name IN ('&&', '||') AND lag(name IN ('&&', '||'), 1, false) OVER (PARTITION BY file_path, fn, run ORDER BY pos))::INT AS more FROM inside WHERE kind = 'binop' AND depth >= 0
), extra AS (
  SELECT file_path, fn, sum(more) AS more FROM operator GROUP BY file_path, fn
), summed AS (
  SELECT file_path, fn, 1 + count(*) FILTER (kind IN ('if', 'guard', 'while', 'for', 'repeat', 'case', 'catch') OR coalesce(name IN ('&&', '||'), false) {folded}) AS cyclomatic,
         sum(CASE WHEN depth < 0 THEN 0 WHEN else_if OR kind IN ('else', 'guard') THEN 1 WHEN kind IN ('if', 'while', 'for', 'repeat', 'switch', 'catch'{", 'ternary'" if fold else ""}) THEN 1 + depth ELSE 0 END) AS cognitive
  FROM inside GROUP BY file_path, fn
)
SELECT file_path, fn::INT AS pos, 'f' || fn AS name, cyclomatic::INT AS cyclomatic, (cognitive + coalesce(more, 0))::INT AS cognitive, CASE WHEN fn >= 100 THEN 'Inner' END AS enclosing_type FROM summed LEFT JOIN extra USING (file_path, fn)
"""


# ---- versions of files in a stream


def followed_files(spark, sf_dir):
    """Events as functions of their user's file, a version for every five days, some deletions; summaries that follow a stream of them."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    gone = (F.col("event_type") == "error") & (F.col("event_id") % 40 == 0)
    metric = lambda m: F.when(~gone, F.col("event_id") % m + 1)
    functions = events.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("file_path"), F.floor(micros() / (5 * 86_400_000_000)).alias("version"), metric(9).alias("cyclomatic"), metric(31).alias("cognitive"), gone.alias("deleted"))
    out, checkpoint = new_path(spark, "summaries"), new_path(spark, "checkpoint")
    follow(functions, out, checkpoint).awaitTermination()
    return followed(spark, out)


FOLLOWED_FILES = """
WITH f AS (
  SELECT 'user ' || user_id AS file_path, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 432000000000)::BIGINT AS version, event_type = 'error' AND event_id % 40 = 0 AS deleted, event_id % 9 + 1 AS cyclomatic, event_id % 31 + 1 AS cognitive FROM events
), latest AS (
  SELECT * FROM f QUALIFY version = max(version) OVER (PARTITION BY file_path)
)
SELECT file_path, version, count(*) AS total_functions, sum(cyclomatic)::BIGINT AS total_cyclomatic, sum(cognitive)::BIGINT AS total_cognitive, max(cyclomatic) AS max_cyclomatic, max(cognitive) AS max_cognitive,
       sum(cyclomatic) / count(*) AS avg_cyclomatic, sum(cognitive) / count(*) AS avg_cognitive
FROM latest GROUP BY file_path, version HAVING NOT bool_or(deleted)
"""


# ---- cohesion of syntax rows and of an index


def line_syntax(spark, sf_dir):
    """Customers as types in files; odd lines of their orders are methods with a name and a call inside, even ones are properties."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("int").alias("owner"), F.concat(F.lit("file "), (F.col("o_custkey") % 20).cast("string")).alias("file_path"))
    lines = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey")
    fn = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int")
    named = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    method = F.col("l_linenumber") % 2 == 1
    own, called = named("m", F.col("l_suppkey") % 9), named("m", F.col("l_suppkey") * 5 % 11)
    read = named("p", F.col("l_partkey") % 12)
    members = lines.select("file_path", "owner", fn.alias("pos"), F.lit("member").alias("row"), F.when(method, "method").otherwise("property").alias("kind"), F.when(method, own).otherwise(read).alias("name"), F.when(method, fn).alias("fn"), (F.col("l_tax") > 0.01).alias("has_body"), (F.col("l_returnflag") == "R").alias("is_static"), (F.col("l_linestatus") == "F").alias("has_accessor"))
    node = lambda kind, name: lines.where(method).select("file_path", fn.alias("pos"), F.lit("node").alias("row"), F.lit(kind).alias("kind"), name.alias("name"), F.array(fn).alias("fns"))
    kind = F.get(F.array(*map(F.lit, ("class", "struct", "actor"))), F.col("owner") % 3)
    types = orders.select("file_path", "owner").distinct().select("file_path", F.col("owner").alias("pos"), F.lit("type").alias("row"), kind.alias("kind"), named("C", F.col("owner")).alias("name"), (F.col("owner") % 90).alias("line"), F.lit(1).alias("column"))
    out = members
    for more in (node("ident", read), node("call", called), types):
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def line_cohesions(spark, sf_dir):
    return cohesion.cohesions(line_syntax(spark, sf_dir)).select("file_path", "pos", "name", "type", "lcom4", "method_count", "property_count", "line", "cohesion_level")


LCOM4 = """
sized AS (
  SELECT t, count(*) FILTER (kind = 'm') AS methods, count(*) FILTER (kind = 'p') AS properties FROM (SELECT t, 'm' AS kind FROM method UNION ALL SELECT t, 'p' FROM property) GROUP BY t
), speaking AS (
  SELECT t, name, max(id) AS id FROM method WHERE has_body GROUP BY t, name
), touch AS (
  SELECT DISTINCT s.t, s.name, a.property FROM speaking s JOIN access a ON a.t = s.t AND a.id = s.id
), link AS (
  SELECT a.t, a.name AS x, b.name AS y FROM touch a JOIN touch b ON a.t = b.t AND a.property = b.property UNION SELECT t, x, y FROM called UNION SELECT t, y, x FROM called
), reach(t, x, y) AS (
  SELECT DISTINCT t, name, name FROM method UNION SELECT r.t, r.x, l.y FROM reach r JOIN link l ON l.t = r.t AND l.x = r.y
), counted AS (
  SELECT t, count(DISTINCT low) AS components FROM (SELECT t, x, min(y) AS low FROM reach GROUP BY t, x) GROUP BY t
), scored AS (
  SELECT t, (CASE WHEN methods = 0 OR properties = 0 THEN 0 WHEN methods = 1 THEN 1 ELSE components END)::INT AS lcom4, methods, properties FROM sized LEFT JOIN counted USING (t)
)
"""

LINE_COHESIONS = f"""
WITH RECURSIVE line AS (
  SELECT o_custkey AS t, l_orderkey * 10 + l_linenumber AS id, l_linenumber % 2 = 1 AS is_method, 'm' || l_suppkey % 9 AS own, 'm' || l_suppkey * 5 % 11 AS callee, 'p' || l_partkey % 12 AS read, l_tax > 0.01 AS has_body, l_returnflag = 'R' AS is_static, l_linestatus = 'F' AS has_accessor
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), method AS (
  SELECT t, id, own AS name, has_body FROM line WHERE is_method AND NOT is_static
), property AS (
  SELECT t, read AS name FROM line WHERE NOT is_method AND NOT is_static AND NOT has_accessor
), inside AS (
  SELECT m.t, id, name, callee, read FROM method m JOIN line USING (id) WHERE is_method
), access AS (
  SELECT DISTINCT i.t, id, read AS property FROM inside i JOIN property p ON p.t = i.t AND p.name = i.read
), called AS (
  SELECT DISTINCT a.t, a.name AS x, b.name AS y FROM inside a JOIN method b ON b.t = a.t AND b.name = a.callee WHERE a.name <> a.callee
), {LCOM4}
SELECT 'file ' || t % 20 AS file_path, t::INT AS pos, 'C' || t AS name, ['class', 'struct', 'actor'][t % 3 + 1] AS type, coalesce(lcom4, 0) AS lcom4, coalesce(methods, 0)::INT AS method_count, coalesce(properties, 0)::INT AS property_count, (t % 90)::INT AS line,
       CASE WHEN coalesce(lcom4, 0) <= 1 THEN 'high' WHEN lcom4 = 2 THEN 'moderate' ELSE 'low' END AS cohesion_level
FROM (SELECT DISTINCT o_custkey AS t FROM orders) LEFT JOIN scored USING (t)
"""


def order_index(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Types to look up, and an index: customers as symbols of types, some of the same name, orders as their members, and uses between orders of a customer."""
    named = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    key = F.col("c_custkey")
    kinds = lambda *all_: F.get(F.array(*map(F.lit, all_)), (key % len(all_)).cast("int"))
    customers = table(spark, sf_dir, "customer")
    types = customers.select(named("file ", F.col("c_nationkey")).alias("file_path"), key.alias("type_pos"), named("C", key % 700).alias("name"), kinds("class", "struct", "actor", "class").alias("type"))
    own = customers.select(named("t", key + 100_000_000).alias("usr"), named("C", key % 700).alias("name"), kinds("class", "struct", "class", "class", "enum").alias("kind"), F.lit(None).cast("string").alias("parent_usr"))
    orders = table(spark, sf_dir, "orders")
    member = F.get(F.array(*map(F.lit, ("instanceMethod", "instanceProperty", "constructor", "instanceMethod", "destructor", "instanceProperty", "staticMethod"))), (F.col("o_orderkey") % 7).cast("int"))
    members = orders.select(named("o", F.col("o_orderkey") + 100_000_000).alias("usr"), named("n", F.col("o_orderkey") % 5).alias("name"), member.alias("kind"), named("t", F.col("o_custkey") + 100_000_000).alias("parent_usr"))
    a, b = (orders.select("o_custkey", F.col("o_orderkey").alias(c)) for c in "ab")
    uses = a.join(b, "o_custkey").where("(a * 3 + b * 5) % 4 = 0")
    occurrences = uses.select(named("o", F.col("b") + 100_000_000).alias("usr"), F.when(F.expr("(a + b) % 3 = 0"), "call").otherwise("reference").alias("role"), named("o", F.col("a") + 100_000_000).alias("container_usr"))
    return types, own.unionByName(members), occurrences


def order_index_cohesions(spark, sf_dir):
    types, symbols, occurrences = order_index(spark, sf_dir)
    return cohesion.index_lcom4(types, symbols, occurrences).select("file_path", "type_pos", "lcom4")


ORDER_INDEX = f"""
WITH RECURSIVE type AS (
  SELECT 'file ' || c_nationkey AS file_path, c_custkey AS t, 'C' || c_custkey % 700 AS name, ['class', 'struct', 'class', 'class'][c_custkey % 4 + 1] AS kind FROM customer
), symbol AS (
  SELECT 't' || (c_custkey + 100000000) AS usr, 'C' || c_custkey % 700 AS name, ['class', 'struct', 'class', 'class', 'enum'][c_custkey % 5 + 1] AS kind FROM customer
), home AS (
  SELECT file_path, t, min(usr) AS usr FROM type JOIN symbol USING (name, kind) GROUP BY file_path, t
), member AS (
  SELECT t, o_orderkey AS id, 'n' || o_orderkey % 5 AS name, ['instanceMethod', 'instanceProperty', 'constructor', 'instanceMethod', 'destructor', 'instanceProperty', 'staticMethod'][o_orderkey % 7 + 1] AS kind FROM home JOIN orders ON 't' || (o_custkey + 100000000) = usr
), method AS (
  SELECT t, id, name, true AS has_body FROM member WHERE kind IN ('instanceMethod', 'constructor')
), property AS (
  SELECT t, id, name FROM member WHERE kind = 'instanceProperty'
), used AS (
  SELECT a.o_orderkey AS a, b.o_orderkey AS b, (a.o_orderkey + b.o_orderkey) % 3 = 0 AS is_call FROM orders a JOIN orders b USING (o_custkey) WHERE (a.o_orderkey * 3 + b.o_orderkey * 5) % 4 = 0
), access AS (
  SELECT DISTINCT m.t, m.id, p.name AS property FROM method m JOIN used ON a = m.id AND NOT is_call JOIN property p ON p.t = m.t AND p.id = b
), called AS (
  SELECT DISTINCT m.t, m.name AS x, c.name AS y FROM method m JOIN used ON a = m.id AND is_call AND a <> b JOIN method c ON c.t = m.t AND c.id = b WHERE m.name <> c.name
), {LCOM4}
SELECT file_path, t AS type_pos, coalesce(lcom4, 0) AS lcom4 FROM home LEFT JOIN scored USING (t)
"""


def stored_index_cohesions(spark, sf_dir):
    """The same from an index in buckets that two batches have filled."""
    types, symbols, occurrences = order_index(spark, sf_dir)
    index = SymbolIndex.open(spark, new_path(spark, "index"), 8)
    for k in range(2):
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(2)) == k
        index.append(symbols.where(part("usr")), occurrences.where(part("usr")), f"batch {k}")
    return index.lcom4(types).select("file_path", "type_pos", "lcom4")


# ---- files of a tree


def table_files(spark, sf_dir):
    """What the tables' own folder holds, listed and read by the tasks; none of it is text."""
    rows = read_tree(spark, [sf_dir], True, exclude=["/check_"], exclude_globs=["*/embeddings*"], tolerant=True, suffix=".parquet")
    name = F.split_part(F.substring("file_path", len(sf_dir.rstrip("/")) + 2, 1 << 20), F.lit("/"), F.lit(1))
    return rows.groupBy(name.alias("name")).agg(F.bool_and(F.col("code").isNull() & F.col("error").isNotNull()).alias("unreadable"))


TABLE_FILES = "SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) || '.parquet' AS name, true AS unreadable"


# ---- source texts


def order_sources(spark, sf_dir) -> DataFrame:
    """A source text for every order: a function in an extension, with statements that its columns choose."""
    n = F.length("o_orderpriority") % 4
    text = F.concat(
        F.lit("extension T"),
        F.col("o_orderstatus"),
        F.lit(" {\n  func f"),
        F.col("o_orderkey").cast("string"),
        F.lit("(x: Int) -> Int {\n"),
        F.when(F.col("o_orderkey") % 2 == 0, "for a in b { while c && d || e { k() } }\n").otherwise("guard x else { return 1 }\n"),
        F.repeat(F.lit("if x { y() } else if z && w { v() } else { u() }\n"), n),
        F.when(F.col("o_orderkey") % 3 == 0, "switch x { case 1: y()\ncase 2, 3: z()\ndefault: w() }\n").otherwise("repeat { do { try y() } catch { z() } } while p\n"),
        F.lit("return 0\n}\n}\n"),
    )
    orders = table(spark, sf_dir, "orders").repartition(4 * partitions(spark))  # parsing is dear, and a file of orders is one task's
    return orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("file_path"), text.alias("code"))


def order_source_metrics(spark, sf_dir):
    with analyze_sources(order_sources(spark, sf_dir)) as result:
        return result.functions.select("file_path", "name", "signature", "cyclomatic", "cognitive", "line", F.col("column").alias("col"), "enclosing_type")


ORDER_SOURCES = """
WITH o AS (
  SELECT *, length(o_orderpriority) % 4 AS n FROM orders
)
SELECT 'o' || o_orderkey AS file_path, 'f' || o_orderkey AS name, 'func f' || o_orderkey || '(x: Int)  -> Int' AS signature,
       (1 + CASE o_orderkey % 2 WHEN 0 THEN 4 ELSE 1 END + 3 * n + 2)::INT AS cyclomatic,
       (CASE o_orderkey % 2 WHEN 0 THEN 4 ELSE 1 END + 3 * n + CASE o_orderkey % 3 WHEN 0 THEN 1 ELSE 3 END)::INT AS cognitive,
       2 AS line, 3 AS col, 'T' || o_orderstatus AS enclosing_type
FROM o
"""

def run_counts(spark, sf_dir):
    """What the run of that analysis met, where one order in seven has left nothing to read, or no text."""
    key = F.col("file_path").substr(F.lit(2), F.length("file_path")).cast("long")
    error = F.when(key % 7 == 1, F.when(key % 2 == 0, "'utf-8' codec can't decode byte 0xff").otherwise("no such file"))
    with analyze_sources(order_sources(spark, sf_dir).withColumn("error", error), tolerant=True) as result:
        return result.counts


RUN_COUNTS = """
SELECT count(*) FILTER (o_orderkey % 7 <> 1) AS files, count(*) FILTER (o_orderkey % 7 <> 1) AS functions, 0::BIGINT AS types, count(*) FILTER (o_orderkey % 7 <> 1) AS members,
       count(*) FILTER (o_orderkey % 7 = 1 AND o_orderkey % 2 = 0) AS not_text, count(*) FILTER (o_orderkey % 7 = 1 AND o_orderkey % 2 = 1) AS unreadable, 0::BIGINT AS unparsed
FROM orders
"""

WITH_ORACLE = {
    span_containers: f"{SIGNUPS} SELECT event_id, span_id FROM held",
    nearest_spans: f"{SIGNUPS} SELECT event_id, span_id, opens FROM place LEFT JOIN (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY opens DESC, closes, span_id) = 1) USING (event_id)",
    bracket_runs: BRACKETS,
    status_components: STATUS_COMPONENTS,
    name_thresholds: NAME_THRESHOLDS,
    followed_files: FOLLOWED_FILES,
    event_metrics: metrics_sql(False),
    folded_event_metrics: metrics_sql(True),
    line_cohesions: LINE_COHESIONS,
    order_index_cohesions: ORDER_INDEX,
    stored_index_cohesions: ORDER_INDEX,
    table_files: TABLE_FILES,
    order_source_metrics: ORDER_SOURCES,
    run_counts: RUN_COUNTS,
}
