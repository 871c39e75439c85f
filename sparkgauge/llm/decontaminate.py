"""Benchmark decontamination by spaced seeds, in DataFrame expressions only.

Tokens are the runs of letters and digits of the lower-cased text.  A seed is the hash of
the tokens that a fixed mask shows of so many tokens in a row; the masks ignore the others.

An item leaks into a document if, on one diagonal, WINDOW tokens in a row of the item (all
of a shorter one) agree with the document's in 80 % of the places; of an item with fewer than
WHOLE tokens all must agree.  Wherever that holds, the two agree under one of the item's masks
at one place, whichever tokens are replaced, so the join of the seeds of the corpus with
those of the benchmark loses no overlap that the check at the hits would accept:

* 13 tokens or more: of any 13 up to two are replaced, which MASKS survive;
* 8 to 12 tokens: one is replaced (8, 9) or two (10 to 12), which SHORT_MASKS survive;
* up to 7 tokens: the mask shows them all.

The corpus is read under those masks only that some item needs.

Defined results: a null or empty text has no seeds and never matches; rows that share an id
are judged each, and ``overlaps`` gives the most equal tokens of them, while ``without_leaks``
takes only those that hold the item; repeated items each match; extra columns are ignored by
``overlaps`` and kept by ``without_leaks``; an empty table gives an empty result, or keeps all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The masks show the first, second, ... of some tokens where they have a one.
MASKS = ("11110011", "11010111")
SHORT_MASKS = ("111011", "11010011", "11111")
WINDOW, SHARE, WHOLE = 13, 0.8, 8
#: Seeds and letters of a benchmark that go to every executor (some 10 MB); more are joined by exchange.
BROADCAST_SEEDS, BROADCAST_LETTERS = 200_000, 4_000_000
#: Bits of the filter that keeps most places from such an exchange, at most.
FILTER_BITS = 1 << 24
#: Ids of leaked documents that go to every executor (some 12 MB); more are joined by exchange.
BROADCAST_IDS = 500_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def masks_of(length: int) -> tuple[str, ...]:
    """The masks of an item of so many tokens."""
    return MASKS if length >= WINDOW else SHORT_MASKS if length >= WHOLE else ("1" * length,) if length else ()


def seeded(rows: DataFrame, words: str, place: str, shown: dict[str, str]) -> DataFrame:
    """A row for each place of the tokens and each mask, with the hash ``key`` of what the mask shows there.

    ``shown`` gives the masks, and a condition under which each is used.  Explode and hash
    run in generated code, which hands the tokens on by reference.
    """

    def under(mask: str) -> str:
        seen = ", ".join(f"get({words}, {place} + {k})" for k, one in enumerate(mask) if one == "1")
        return f"if({shown[mask]} and {place} <= size({words}) - {len(mask)}, xxhash64('{mask}', {seen}), null)"

    kept = rows.columns
    out = rows.select(*kept, F.posexplode_outer(words).alias(place, "_token"))
    return out.select(*kept, place, F.explode(F.array(*(F.expr(under(m)) for m in shown))).alias("key")).where("key is not null")


def item_masks(items: DataFrame) -> dict[str, str]:
    """Every mask that some item needs, and which items use it."""
    lengths = sorted(r[0] for r in items.select(F.least(F.size("item"), F.lit(WINDOW))).distinct().collect())  # WINDOW + 1 numbers at most
    found: dict[str, list[int]] = {}
    for n in lengths:
        for mask in masks_of(n):
            found.setdefault(mask, []).append(n)
    return {mask: f"least(size(item), {WINDOW}) in ({', '.join(map(str, ns))})" for mask, ns in found.items()}


def verified(hits: DataFrame, by: list[str]) -> DataFrame:
    """Documents and items with a hit whose diagonal has a window that agrees well enough.

    The verdict is filtered after the aggregate: as a condition of the join it would
    run outside generated code, and every place would copy its document's tokens.
    """
    equal = F.expr("transform(item, (t, k) -> if(t <=> get(words, place - at + k), 1, 0))").alias("equal")
    hits = hits.select(*by, equal, F.expr(f"least(size(item), {WINDOW})").alias("width"))
    best = "array_max(transform(sequence(0, size(equal) - width), s -> aggregate(slice(equal, s + 1, width), 0, (a, x) -> a + x)))"
    hits = hits.select(
        *by,
        F.expr(f"{best} >= if(width < {WHOLE}, width, ceil({SHARE}D * width))").alias("good"),
        F.expr("aggregate(equal, 0, (a, x) -> a + x)").cast("long").alias("n_equal"),
        F.size("equal").cast("long").alias("n_item"),
    )
    found = hits.groupBy(*by).agg(F.max(F.expr("if(good, n_equal, null)")).alias("n_equal"), F.max(F.expr("if(good, n_item, null)")).alias("n_item"))
    return found.where("n_equal is not null")


def possible(known: DataFrame, seeds: int) -> Column:
    """Whether a key may be one of the seeds: bits of a filter, as a constant array of the plan."""
    bits = min(FILTER_BITS, 1 << max(6, (8 * seeds).bit_length()))
    words = known.select(F.expr(f"cast(shiftright(key & {bits - 1}L, 6) as int)").alias("w"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bit"))
    found = dict(words.toArrow().to_pandas().itertuples(index=False))  # bits / 64 rows at most
    constant = F.split(F.lit(",".join(str(found.get(w, 0)) for w in range(bits // 64))), ",").cast("array<long>")
    return F.get(constant, F.expr(f"cast(shiftright(key & {bits - 1}L, 6) as int)")).bitwiseAND(F.expr("shiftleft(1L, cast(key & 63 as int))")) != 0


def leaks(docs: DataFrame, benchmark: DataFrame, by: list[str], id_col: str, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    """(*by, n_equal, n_item), where ``by`` is of doc_id, digest (of the document's text) and item_id."""
    text, item_text = F.col(text_col).cast("string"), F.col(item_text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), tokens(text).alias("words"))
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.xxhash64(item_text).alias("item_digest"), tokens(item_text).alias("item")).where("size(item) > 0").distinct()
    items = stored(items, "items")
    shown = item_masks(items)
    if not shown:
        return rows.where("false").withColumns({"item_id": F.lit(0).cast("long")}).select(*by, F.lit(0).cast("long").alias("n_equal"), F.lit(0).cast("long").alias("n_item"))
    known = seeded(items, "item", "at", shown).select("key", "item_id", "item_digest", "at")
    seeds, letters = known.count(), items.agg(F.sum(F.expr("aggregate(item, 0L, (a, t) -> a + length(t) + 8)"))).first()[0]
    places = seeded(rows, "words", "place", dict.fromkeys(shown, "true"))
    same = F.expr("_id <=> item_id and _digest = item_digest")
    named = items.select(F.col("item_id").alias("_id"), F.col("item_digest").alias("_digest"), "item")
    if seeds <= BROADCAST_SEEDS and letters <= BROADCAST_LETTERS:
        return verified(places.join(F.broadcast(known), "key").join(F.broadcast(named), same), by)
    # beyond that: places that may be seeds meet them, and only documents with hits fetch their tokens again
    lean = places.select("doc_id", "digest", "place", "key").where(possible(known, seeds))
    hits = stored(lean.join(known, "key").drop("key").distinct(), "hits")
    hit = F.xxhash64("doc_id", "digest").alias("key")
    ids = hits.select(hit).distinct()
    hits = hits.join(named, same).drop("_id", "_digest")
    whole = rows.select("*", hit).where(possible(ids, ids.count()))  # a filter of bits, so that the rest is not moved
    whole = whole.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "words").dropDuplicates(["_id", "_digest"])
    return verified(hits.join(whole, F.expr("_id <=> doc_id and _digest = digest")), by)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_equal, n_item) for every document and item that leaks into it."""
    return leaks(docs, benchmark, ["doc_id", "item_id"], id_col, text_col, item_id_col, item_text_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaks."""
    found = leaks(docs, benchmark, ["doc_id", "digest", "item_id"], id_col, text_col, "item_id", "text")
    leaked = stored(found.select(F.col("doc_id").alias("_leaked_id"), F.col("digest").alias("_leaked_digest")).distinct(), "leaked")
    if leaked.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        leaked = F.broadcast(leaked)  # else documents and ids meet by exchange
    same = docs[id_col].cast("long").eqNullSafe(leaked["_leaked_id"]) & (F.xxhash64(docs[text_col].cast("string")) == leaked["_leaked_digest"])
    return docs.join(leaked, same, "left_anti")


#: The same rules without seeds, for DuckDB: every diagonal on which enough tokens agree.
OVERLAPS_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS words FROM documents
), item AS (
  SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS item FROM benchmark
), asked AS (
  SELECT *, len(item) AS n_item, least(len(item), {WINDOW}) AS width, CASE WHEN len(item) < {WHOLE} THEN len(item) ELSE ceil({SHARE} * least(len(item), {WINDOW})) END AS least_equal FROM item WHERE len(item) > 0
), doc_token AS (
  SELECT rid, unnest(words) AS token, generate_subscripts(words, 1) AS place FROM doc
), item_token AS (
  SELECT iid, unnest(item) AS token, generate_subscripts(item, 1) AS spot FROM asked
), diagonal AS (
  SELECT rid, iid, place - spot AS shift, count(*) AS n_equal FROM doc_token JOIN item_token USING (token) GROUP BY ALL
), aligned AS (
  SELECT rid, iid, n_equal, unnest(range(1, n_item + 1)) AS k, n_item, width, least_equal, shift,
         item[k] IS NOT DISTINCT FROM CASE WHEN k + shift BETWEEN 1 AND len(words) THEN words[k + shift] END AS same
  FROM diagonal JOIN doc USING (rid) JOIN asked USING (iid) WHERE n_equal >= least_equal
), summed AS (
  SELECT *, sum(same::INT) OVER (PARTITION BY rid, iid, shift ORDER BY k ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS near FROM aligned
)
SELECT doc_id, item_id, max(n_equal)::BIGINT AS n_equal, max(s.n_item)::BIGINT AS n_item
FROM summed s JOIN doc USING (rid) JOIN item USING (iid) WHERE k >= width AND near >= least_equal GROUP BY doc_id, item_id
"""
