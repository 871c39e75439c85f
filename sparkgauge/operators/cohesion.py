"""LCOM4: connected components of the methods of a type, linked by shared properties and calls.

The plan runs on members, accesses and calls as tables, whether they come from syntax or
from a symbol index.  Methods link to properties, not to each other, so their number of
links is linear; components of all types are found at once, type by type in Arrow, or by
rounds over all tasks where a type is larger than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .components import count_components

KEY = ["file_path", "type_pos"]


def lcom4(methods: DataFrame, properties: DataFrame, accesses: DataFrame, calls: DataFrame, key: list[str]) -> DataFrame:
    """(key, lcom4) of types with methods.

    ``methods`` has a row for each method (``name``, ``id``), ``accesses`` (``id``, ``property``) and ``calls``
    (``name``, ``callee``).  Vertices are names: overloads are one vertex, of which the last with a body speaks for
    the properties, though they count one by one where a type has fewer than two.
    """
    sizes = methods.groupBy(*key).agg(F.count("*").alias("n_methods")).join(properties.groupBy(*key).agg(F.count("*").alias("n_properties")), key, "left")
    sizes = sizes.withColumn("n_properties", F.coalesce("n_properties", F.lit(0)))
    graph = sizes.where("n_methods > 1 and n_properties > 0").select(*key)
    vertices = methods.join(graph, key, "left_semi").select(*key, "name").distinct()
    last = Window.partitionBy(*key, "name").orderBy(F.col("id").desc())
    speaking = methods.where("has_body").withColumn("rank", F.row_number().over(last)).where("rank = 1").select(*key, "name", "id")
    shared = accesses.join(speaking, [*key, "id"]).select(*key, F.concat(F.lit("m:"), "name").alias("src"), F.concat(F.lit("p:"), "property").alias("dst"))
    called = calls.where("name != callee").select(*key, F.concat(F.lit("m:"), "name").alias("src"), F.concat(F.lit("m:"), "callee").alias("dst"))
    edges = shared.unionByName(called).join(graph, key, "left_semi").distinct()
    found = count_components(vertices.withColumn("name", F.concat(F.lit("m:"), "name")), edges, key)
    early = F.when(F.col("n_methods") == 1, F.when(F.col("n_properties") == 0, 0).otherwise(1)).when(F.col("n_properties") == 0, 0)
    return sizes.join(found, key, "left").select(*key, F.coalesce(early, F.col("components")).cast("int").alias("lcom4"))


def cohesion_level(lcom: Column) -> Column:
    return F.when(lcom <= 1, "high").when(lcom == 2, "moderate").otherwise("low")


def type_members(syntax: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Types, instance methods and stored instance properties."""
    types = syntax.where("row = 'type'").select("file_path", F.col("pos").alias("type_pos"), "name", F.col("kind").alias("type"), "line", "column")
    members = syntax.where("row = 'member' and owner >= 0 and not coalesce(is_static, false)").withColumnRenamed("owner", "type_pos")
    methods = members.where("kind = 'method'").select(*KEY, "name", F.col("fn").alias("id"), "has_body")
    properties = members.where("kind = 'property' and not has_accessor").select(*KEY, "name")
    return types, methods, properties


def accessed(names: DataFrame, properties: DataFrame, key: list[str]) -> DataFrame:
    """(key, id, property): which names in which methods (``id``) are those of properties of the same type, each once."""
    return names.join(properties.select(*key, "name").distinct(), [*key, "name"], "left_semi").select(*key, "id", F.col("name").alias("property")).distinct()


def syntax_lcom4(syntax: DataFrame) -> DataFrame:
    """(file_path, type_pos, lcom4) from names and calls in the bodies of methods."""
    _, methods, properties = type_members(syntax)
    names = syntax.where("row = 'node' and kind in ('ident', 'call')").select("file_path", "kind", "name", F.explode("fns").alias("id"))
    inside = names.join(methods.select(*KEY, "id", F.col("name").alias("method")), ["file_path", "id"])
    accesses = accessed(inside.where("kind = 'ident'"), properties, KEY)
    known = methods.select(*KEY, F.col("name").alias("callee")).distinct()
    calls = inside.where("kind = 'call'").select(*KEY, F.col("method").alias("name"), F.col("name").alias("callee")).join(known, [*KEY, "callee"], "left_semi").distinct()
    return lcom4(methods, properties, accesses, calls, KEY)


def homes(symbols: DataFrame) -> DataFrame:
    """(name, kind, parent_usr): the symbol of each class or struct, the first of equals."""
    return symbols.where("kind in ('class', 'struct')").groupBy("name", "kind").agg(F.min("usr").alias("parent_usr"))


def counted_members(methods: DataFrame, properties: DataFrame, key: list[str]) -> DataFrame:
    """(key, method_count, property_count) of every key that has either."""
    counts = [rows.groupBy(*key).agg(F.count("*").cast("int").alias(name)) for rows, name in ((methods, "method_count"), (properties, "property_count"))]
    return counts[0].join(counts[1], key, "full").na.fill(0, ["method_count", "property_count"])


def index_lcom4(types: DataFrame, symbols: DataFrame, occurrences: DataFrame, own_types: DataFrame | None = None) -> DataFrame:
    """(file_path, type_pos, lcom4) of the types that a symbol index knows.

    ``symbols`` (usr, name, kind, parent_usr) and ``occurrences`` (usr, role, container_usr);
    a type is found by name and kind, actors as classes, the first symbol of equals, among
    ``own_types`` if the index has a table of these.  Types that find the same symbol share its
    graph, which is counted once; members and their uses are read once and written.
    """
    kind = F.when(F.col("type") == "struct", "struct").otherwise("class")
    wanted = types.select(*KEY, "name", kind.alias("kind"))
    found = wanted.join(homes(symbols if own_types is None else own_types), ["name", "kind"]).select(*KEY, "parent_usr")
    home = ["parent_usr"]
    members = symbols.where("kind in ('instanceMethod', 'constructor', 'instanceProperty')").join(found.select(*home).distinct(), home, "left_semi")
    members = stored(members.select("usr", "name", "kind", *home).distinct(), "members")
    methods = members.where("kind != 'instanceProperty'").select(*home, "name", F.col("usr").alias("id"), F.lit(True).alias("has_body"))
    properties = members.where("kind = 'instanceProperty'").select(*home, "name", "usr")
    uses = occurrences.where("role in ('reference', 'call')").select("usr", "role", F.col("container_usr").alias("id"))
    used = stored(methods.select(*home, "id", F.col("name").alias("method")).join(uses, "id").distinct(), "uses")
    accesses = used.where("role = 'reference'").join(properties.select(*home, "usr", F.col("name").alias("property")), [*home, "usr"]).select(*home, "id", "property").distinct()
    callees = methods.select(*home, F.col("id").alias("usr"), F.col("name").alias("callee"))
    calls = used.where("role = 'call' and usr != id").join(callees, [*home, "usr"]).select(*home, F.col("method").alias("name"), "callee").distinct()
    return found.join(lcom4(methods, properties, accesses, calls, home), home, "left").select(*KEY, F.coalesce("lcom4", F.lit(0)).alias("lcom4"))


def cohesions(syntax: DataFrame, symbols: DataFrame | None = None, occurrences: DataFrame | None = None) -> DataFrame:
    """One row for each class, struct and actor; where an index knows a type its graph counts, else syntax does."""
    types, methods, properties = type_members(syntax)
    scores = syntax_lcom4(syntax)
    if symbols is not None and occurrences is not None:
        indexed = index_lcom4(types, symbols, occurrences).withColumnRenamed("lcom4", "indexed")
        scores = types.select(*KEY).join(scores, KEY, "left").join(indexed, KEY, "left").select(*KEY, F.coalesce("indexed", "lcom4").alias("lcom4"))
    out = types.join(scores, KEY, "left").join(counted_members(methods, properties, KEY), KEY, "left")
    zero = F.lit(0)
    out = out.select("file_path", F.col("type_pos").alias("pos"), "name", "type", F.coalesce("lcom4", zero).alias("lcom4"), F.coalesce("method_count", zero).alias("method_count"), F.coalesce("property_count", zero).alias("property_count"), "line", "column")
    return out.withColumn("cohesion_level", cohesion_level(F.col("lcom4")))
