r"""Quality rules by a hashed n-gram log-likelihood ratio, in DataFrame expressions only.

The n-grams are the words and the pairs of neighbouring words, hashed by CRC-32 into BUCKETS
buckets for either length.  Two multinomials over the buckets of each length, one of the
trusted target (all documents that labels call good) and one of the raw corpus scaled to the
target's size, give each bucket a weight: the logarithm of the ratio of its counts, each
raised by SMOOTH, so that what a small target happens not to hold weighs little.  A
document's score is the sum of the weights of its n-grams for each of its words; it is kept
if it passes the base rules and its score reaches THRESHOLD.

Counts cover all documents; what the driver holds is one row for each bucket.

Defined results: a null or empty text has no words and fails the base rules; every row
is judged by itself, so repeated rows and ids get the same verdict; without any trusted
document all weights are zero; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of words, and as many of pairs.
BUCKETS = 1 << 14
#: Ids of trusted documents that go to every executor (some 12 MB); more are joined by exchange.
BROADCAST_IDS = 500_000
#: What is added to the counts of words and of pairs.
SMOOTH = (3, 30)
#: Documents that are, by the word, this much less likely in the target than in the corpus (natural logarithm) go.
THRESHOLD = -0.24
SPACE = r"\x20\x09-\x0D"


def words(text: str) -> Column:
    return F.expr(rf"regexp_extract_all(coalesce({text}, ''), '([^{SPACE}]+)', 1)".replace("\\", "\\\\"))


def hashed(word: str) -> str:
    return f"crc32(cast({word} as binary))"


def pair(first: str, second: str) -> str:
    """Bucket of two words in a row, by their hashes, behind those of single words."""
    return f"cast({BUCKETS} + ({first} * 31 + {second}) % {BUCKETS} as int)"


def fenced(expression: str) -> Column:
    """The same, in a form below which no filter moves: there it would work out the nested arrays once for every mention."""
    return F.expr(f"if(monotonically_increasing_id() >= 0, {expression}, null)")


def base_measures(docs: DataFrame, text: str, w: str) -> DataFrame:
    """Adds the base columns; ``text`` and ``w`` name the text and its words.

    A window is found twice if its hash is; positions come out in order, and the words
    that windows cover are counted from the steps between positions.
    """
    out = docs.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long"),
            "_lines": F.expr(rf"filter(split(coalesce({text}, ''), '\\n'), l -> l rlike '[^{SPACE}]')".replace("\\x", "\\\\x")),
            "_grams": F.expr(f"if(size({w}) < 3, array(), transform(sequence(0, size({w}) - 3), i -> xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2))))"),
        }
    )
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    none = "cast(array() as array<struct<h: bigint, i: int>>)"
    out = out.withColumn("_sorted", F.expr(f"if(size(array_distinct(_grams)) = size(_grams), {none}, sort_array(transform(_grams, (h, i) -> named_struct('h', h, 'i', i))))"))
    out = out.withColumn("_at", F.expr("sort_array(transform(filter(_sorted, (x, k) -> coalesce(get(_sorted, k - 1).h = x.h, false) or coalesce(get(_sorted, k + 1).h = x.h, false)), x -> x.i))"))
    out = out.withColumn("n_repeat_words", fenced("aggregate(transform(_at, (p, k) -> least(3, coalesce(get(_at, k + 1) - p, 3))), 0L, (a, x) -> a + x)"))
    return out.withColumn("base_failed", fenced("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).drop("_lines", "_grams", "_sorted", "_at")


def trusted(labels: DataFrame) -> DataFrame:
    """The ids that labels call good; broadcast while their number is bounded."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("good", F.lit(1))
    return F.broadcast(good) if good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else good


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The weight of each bucket, those of pairs behind those of words; counts are over all documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(trusted(labels), "doc_id", "left").select("good", words("text").alias("w"))
    places = rows.select("good", "w", F.posexplode("w").alias("i", "word"))
    one, two = f"cast({hashed('word')} % {BUCKETS} as int)", f"if(i + 1 < size(w), {pair(hashed('word'), hashed('get(w, i + 1)'))}, null)"
    grams = places.select("good", F.explode(F.expr(f"array({one}, {two})")).alias("bucket")).where("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target")).toArrow().to_pydict()
    raw, target = [0] * (2 * BUCKETS), [0] * (2 * BUCKETS)
    for b, r, t in zip(counts["bucket"], counts["raw"], counts["target"]):
        raw[b], target[b] = r, t
    out = []
    for more, own in zip(SMOOTH, (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS))):
        share = sum(target[own]) / max(1, sum(raw[own]))
        out += [math.log((t + more) / (r * share + more)) if share else 0.0 for t, r in zip(target[own], raw[own])]
    return out


def judged(docs: DataFrame, weight: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with the words' columns, ``score`` and ``kept``."""
    out = base_measures(docs.withColumn("_w", words(f"`{text_col}`")), text_col, "_w")
    constant = F.split(F.lit(",".join(map(repr, weight))), ",").cast("array<double>")  # the optimiser makes it one constant

    def gain(h: Column, i: Column) -> Column:
        after = F.get(F.col("_h"), i + 1)
        both = F.get(constant, (BUCKETS + (h * 31 + after) % BUCKETS).cast("int"))
        return F.get(constant, (h % BUCKETS).cast("int")) + F.coalesce(both, F.lit(0.0))

    out = out.withColumn("_h", F.expr(f"transform(_w, x -> {hashed('x')})"))
    out = out.withColumn("_gain", F.aggregate(F.transform("_h", gain), F.lit(0.0), lambda a, x: a + x))
    out = out.withColumn("score", F.expr("if(n_words = 0, 0D, _gain / n_words)"))
    return out.withColumn("kept", fenced(f"not base_failed and score >= {THRESHOLD}D")).drop("_w", "_h", "_gain")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base measures and the verdict of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = judged(rows, weights(rows, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that pass, with the columns of ``docs``."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    out = judged(whole, weights(docs, labels, id_col, text_col))
    return out.select("row", "kept").where("kept").select("row.*")


def crc_table() -> list[int]:
    """The remainders of the reflected polynomial of CRC-32, by byte."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


#: The same for DuckDB; distinct words are hashed there byte by byte.
QUALITY_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w FROM documents
), word AS (
  SELECT rid, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc
), gram AS (
  SELECT rid, i, word || ' ' || lead(word) OVER t || ' ' || lead(word, 2) OVER t AS gram FROM word WINDOW t AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM gram WHERE gram IS NOT NULL
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid
), line AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM doc
), again AS (
  SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM line WHERE regexp_matches(line, '[^{SPACE}]') GROUP BY rid
), coded AS (
  SELECT word, list_transform(range(0, length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT word FROM word)
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, {crc_table()}[(xor(c, b) & 255) + 1]))) AS h FROM coded
), lined AS (
  SELECT rid, doc_id, h, lead(h) OVER (PARTITION BY rid ORDER BY i) AS after FROM word JOIN hashed USING (word)
), sized AS (
  SELECT rid, doc_id, 0 AS kind, h % {BUCKETS} AS bucket FROM lined UNION ALL SELECT rid, doc_id, 1, (h * 31 + after) % {BUCKETS} FROM lined WHERE after IS NOT NULL
), counted AS (
  SELECT kind, bucket, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)) AS target FROM sized GROUP BY kind, bucket
), chance AS (
  SELECT kind, bucket, target, raw * sum(target) OVER (PARTITION BY kind) / sum(raw) OVER (PARTITION BY kind) AS expected, [{SMOOTH[0]}, {SMOOTH[1]}][kind + 1] AS more, sum(target) OVER (PARTITION BY kind) AS trusted FROM counted
), score AS (
  SELECT rid, sum(CASE WHEN trusted = 0 THEN 0 ELSE ln((target + more) / (expected + more)) END) / count(*) FILTER (kind = 0) AS score FROM sized JOIN chance USING (kind, bucket) GROUP BY rid
), base AS (
  SELECT doc.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, score
  FROM doc LEFT JOIN again USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN score USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(score, 0) >= {THRESHOLD} AS kept
FROM base
"""
