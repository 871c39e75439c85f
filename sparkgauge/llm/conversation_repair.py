r"""Conversation structure repair: faults as signatures, cheapest edits by a trie-shared DP.

Every row of a conversation becomes one letter, its role's class with its fault; the letters
in order are the conversation's signature.  Signatures are sorted, so that those with a
common prefix follow each other, which walks their prefix trie depth first: of the trie
only the path to the current node is held, the layer of each node is computed once for all
signatures that share it, and an answer is emitted at each terminal node.

A layer holds, for each state of the role pattern ``(s?(ua)+)?``, the cheapest cost and the
rank of its edits among the layer's.  Edits of a layer end in the edit of a row, so none is
the beginning of another and ranks decide all ties.  Costs within a layer count from the
cheapest, so there are few different layers, and each step between two is worked out once.

Rows are dealt and sorted by conversation and read as a stream: a task holds a batch, and
for the conversation at hand a letter a row.  Signatures of conversations are dealt by
ranges, the id included, so a signature that many share is spread.  The digest of a
repaired conversation is one stream over its rows, which one task reads in order.

Defined results: a null role, text, id or turn is one space in texts and in the damage's
key; a null id is a conversation of its own; null turns come first and count in no gap; rows
of the same turn go by the digest of role and text, copies behind each other; a role
without a letter, or with another than s, u, a, is foreign; a conversation without rows
after the damage has zeros, no edits and the digest of nothing; other input columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import BATCH, small_batches, stored, tidy

BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: Costs of edits; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, after the system's row, after a user's, after an assistant's; where a row of each role leads.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
#: The role that an edit may give a row in each state.
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
#: Letter of a row that must go; other letters are roles, capitals where the text is cut off.
MUST_GO, FOREIGN = "x", "o"

Layer = tuple[tuple[int, int] | None, ...]
Back = tuple[tuple[int, str] | None, ...]


def insertions(state: int) -> list[tuple[str, int]]:
    """(edits, state) that inserted rows alone lead to; none that comes back to a state is ever the cheapest."""
    out, edits = [("", state)], "I"
    while (after := STEPS[out[-1][1], NEXT[out[-1][1]]]) not in [s for _, s in out]:
        out.append((edits, after))
        edits += "I"
    return out


INSERTIONS = [insertions(s) for s in range(4)]
START: Layer = ((0, 0), None, None, None)


@lru_cache(None)  # layers are few: their costs lie within a bound of each other
def step(layer: Layer, letter: str) -> tuple[Layer, int, Back]:
    """The next layer, by how much its cheapest cost rises, and for each state where its edits come from."""
    role, cut = letter.lower(), TRUNCATED * letter.isupper()
    found: dict[int, tuple[int, int, str, int]] = {}

    def offer(state: int, cost: int, rank: int, edits: str, source: int) -> None:
        new = (cost, rank, edits, source)
        if state not in found or new < found[state]:
            found[state] = new

    for source, entry in enumerate(layer):
        if entry is None:
            continue
        for inserted, state in INSERTIONS[source]:
            cost, rank = entry[0] + INSERT * len(inserted), entry[1]
            offer(state, cost + DELETE, rank, inserted + "D", source)
            if letter != MUST_GO:
                if (state, role) in STEPS:
                    offer(STEPS[state, role], cost + cut, rank, inserted + "K", source)
                offer(STEPS[state, NEXT[state]], cost + REROLE + cut, rank, inserted + "R", source)
    least = min(f[0] for f in found.values())
    ranks = {key: i for i, key in enumerate(sorted({f[1:3] for f in found.values()}))}
    after = tuple((found[s][0] - least, ranks[found[s][1:3]]) if s in found else None for s in range(4))
    return after, least, tuple((found[s][3], found[s][2]) if s in found else None for s in range(4))


class Trie:
    """The path to the current node of the prefix trie of sorted signatures."""

    def __init__(self) -> None:
        self.signature = ""
        self.layers: list[Layer] = [START]
        self.costs = [0]
        self.backs: list[Back] = []
        self.answer: tuple[int, str] | None = None
        self.steps = 0

    def solve(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of the cheapest repair."""
        if self.answer is not None and signature == self.signature:
            return self.answer
        shared = 0
        for a, b in zip(signature, self.signature):
            if a != b:
                break
            shared += 1
        del self.layers[shared + 1 :], self.costs[shared + 1 :], self.backs[shared:]
        for letter in signature[shared:]:
            layer, more, back = step(self.layers[-1], letter)
            self.layers.append(layer)
            self.costs.append(self.costs[-1] + more)
            self.backs.append(back)
            self.steps += 1
        self.signature, self.answer = signature, self.terminal()
        return self.answer

    def terminal(self) -> tuple[int, str]:
        ends = [(entry[0] + INSERT * len(more), entry[1], more, source) for source, entry in enumerate(self.layers[-1]) if entry for more, state in INSERTIONS[source] if state in ACCEPTED]
        cost, _, edits, state = min(ends)
        parts = [edits]
        for back in reversed(self.backs):
            state, edits = back[state]
            parts.append(edits)
        return self.costs[-1] + cost, "".join(reversed(parts))


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped): the rows after the damage that follows from id and turn; dropped rows are marked, so that no conversation is lost."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), F.expr(f"crc32(cast(concat(coalesce(cast(`{id_col}` as string), ' '), ':', coalesce(cast(`{turn_col}` as string), ' ')) as binary)) % 20").alias("fate"))
    told = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.col("fate") == 0, F.when(F.col("fate") == 3, 2).otherwise(1))).alias("dropped")
    return rows.select("conv_id", "turn", role.alias("role"), told.alias("text"), copies)


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations as they are, in the same form."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(False).alias("dropped"))


def digested(rows: DataFrame) -> DataFrame:
    """With ``digest``, equal for rows of the same role and text."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))


#: Ascending, so nulls come first.
IN_ORDER = ["conv_id", "turn", "digest"]
FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def keyed(rows: DataFrame, *more: str) -> StructType:
    """A schema that begins with ``conv_id`` as the rows have it."""
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL(", ".join(more))])


def arrow_of(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def streamed(batches: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[tuple]:
    """Rows by the column ``key``: (its value, an iterator over its rows), however many batches they span."""
    return groupby((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), itemgetter(key))


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 1000, letters: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Arrow batches of some rows, and of some letters, each."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= letters:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, faults, signature) of every conversation; no text is exchanged, only its digest."""
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(FOREIGN)
    light = digested(rows).select("conv_id", "turn", "digest", "dropped", letter.alias("letter"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut"))
    earlier = Window.partitionBy("conv_id", "digest", "dropped").orderBy(F.col("turn").asc_nulls_first())
    light = light.repartition("conv_id").withColumn("again", F.row_number().over(earlier) > 1)  # a window within what is dealt already
    schema = keyed(rows, *(f"{c} long" for c in FAULTS), "signature string")
    arrow = arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for conv_id, own in streamed(batches):
                blank = duplicate = truncated = illegal = turns = 0
                first = last = None
                before, signature = "", []
                for _, turn, dropped, letter, empty, cut, again in own:
                    if dropped:
                        continue
                    if turn is not None and turn != last:
                        first, last, turns = turn if first is None else first, turn, turns + 1
                    illegal += before != "" and before + letter not in ("su", "ua", "au")
                    before = letter
                    if empty or again:
                        blank, duplicate = blank + empty, duplicate + (not empty)
                        signature.append(MUST_GO)
                    else:
                        truncated += cut
                        signature.append(letter.upper() if cut else letter)
                yield conv_id, 0 if first is None else last - first + 1 - turns, blank, duplicate, truncated, illegal, "".join(signature)

        yield from in_batches(found(), arrow)

    ordered = light.sortWithinPartitions(*IN_ORDER, "again").select("conv_id", "turn", "dropped", "letter", "blank", "cut", "again")
    return ordered.mapInArrow(tidy(run), schema)


def answers(found: DataFrame) -> DataFrame:
    """(conv_id, faults, cost, audit): every signature's cheapest edits, from the trie of all that a task holds."""
    schema = keyed(found, *(f"{c} long" for c in (*FAULTS, "cost")), "audit string")
    arrow = arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        yield from in_batches(((*row[:-1], *trie.solve(row[-1])) for row in rows), arrow)

    ordered = found.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature")
    return ordered.select("conv_id", *FAULTS, "signature").mapInArrow(tidy(run), schema)


def edited(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The rows that the edits leave."""
    state, at = 0, 0

    def given(text: str) -> tuple[str, str]:
        nonlocal state
        role = NEXT[state]
        state = STEPS[state, role]
        return ROLES[role], text

    for role, text in rows:
        while audit[at] == "I":
            yield given("")
            at += 1
        if audit[at] == "K":
            state = STEPS[state, role[:1]]
            yield role, text
        elif audit[at] == "R":
            yield given(text)
        at += 1
    for _ in audit[at:]:
        yield given("")


def with_edits(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Rows in order, each conversation's answer before them."""
    both = digested(rows).where("not dropped").select("conv_id", "turn", "digest", "role", "text").unionByName(solved, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *IN_ORDER[1:]).select("conv_id", "role", "text", *FAULTS, "cost", "audit")


def prepared(rows: DataFrame) -> DataFrame:
    """Rows and answers as ``with_edits`` gives them."""
    small_batches(rows.sparkSession)
    return with_edits(rows, answers(stored(signatures(rows), "signatures")))


def repairs(rows: DataFrame) -> DataFrame:
    """Faults, cost, edits and digest of the repaired rows, for every conversation of ``damaged`` or ``undamaged`` rows."""
    schema = keyed(rows, *(f"{c} long" for c in (*FAULTS, "cost")), "audit string", "repaired_sha256 string")
    arrow = arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for _, own in streamed(batches):
                answer = next(own)
                digest, comma = hashlib.sha256(), ""
                for role, text in edited(answer[-1], (r[1:3] for r in own)):
                    digest.update(f"{comma}{role}:{text}".encode())
                    comma = "\n"
                yield answer[0], *answer[3:], digest.hexdigest()

        yield from in_batches(found(), arrow)

    return prepared(rows).mapInArrow(tidy(run), schema)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations themselves."""
    schema = keyed(rows, "place long", "role string", "text string")
    arrow = arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for conv_id, own in streamed(batches):
                audit = next(own)[-1]
                for place, (role, text) in enumerate(edited(audit, (r[1:3] for r in own))):
                    yield conv_id, place, role, text

        yield from in_batches(found(), arrow)

    return prepared(rows).mapInArrow(tidy(run), schema)


def repairs_sql(crc_table: list[int]) -> str:
    """The same for DuckDB: layers of all conversations row by row, each state with its cheapest edits and the rows that they leave."""
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    inserts = ", ".join(f"({source}, {len(edits) * INSERT}, '{edits}', '{'|'.join(made)}', {state})" for source in range(4) for edits, state in INSERTIONS[source] for made in [inserted_roles(source, len(edits))])
    steps = ", ".join(f"({state}, '{role}', {after})" for (state, role), after in STEPS.items())
    given = ", ".join(f"({state}, '{ROLES[role]}', {STEPS[state, role]})" for state, role in NEXT.items())
    lines = "list_concat(l.lines, CASE WHEN made = '' THEN [] ELSE list_transform(string_split(made, '|'), lambda r: r || ':') END)"
    return f"""
WITH RECURSIVE given(source, role, after) AS (VALUES {given}), steps(source, initial, after) AS (VALUES {steps}), inserts(source, more, edits, made, mid) AS (VALUES {inserts}),
coded AS (
  SELECT *, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations
), hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(k)), lambda i: ('0x' || substr(hex(k), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, {crc_table}[(xor(c, b) & 255) + 1]))) % 20 AS fate FROM coded
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE r END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS text, unnest(CASE fate WHEN 3 THEN [1, 2] WHEN 0 THEN [] ELSE [1] END) AS copy FROM hashed
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i, rtrim(text, {blanks}) AS bare FROM damaged
), judged AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS both_initials FROM ordered
), faulty AS (
  SELECT *, blank OR again AS must_go, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM judged
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (both_initials NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id
), layer(conv_id, i, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM counted
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT l.conv_id, l.i + 1 AS i, o.after AS state, l.cost + more + o.cost AS cost, l.audit || edits || o.op AS audit, list_concat({lines}, o.line) AS lines
    FROM layer l JOIN inserts s ON s.source = l.state JOIN (
      SELECT f.conv_id, f.i, g.source, e.op, e.after, e.cost, e.line FROM faulty f, given g LEFT JOIN steps t ON t.source = g.source AND t.initial = left(f.role, 1), unnest([
        {{'op': 'D', 'after': g.source, 'cost': {DELETE}, 'line': []::VARCHAR[]}},
        {{'op': 'K', 'after': CASE WHEN NOT f.must_go THEN t.after END, 'cost': {TRUNCATED} * f.cut::INT, 'line': [f.role || ':' || f.text]}},
        {{'op': 'R', 'after': CASE WHEN NOT f.must_go THEN g.after END, 'cost': {REROLE} + {TRUNCATED} * f.cut::INT, 'line': [g.role || ':' || f.text]}}]) AS u(e)
      WHERE e.after IS NOT NULL
    ) o ON o.conv_id IS NOT DISTINCT FROM l.conv_id AND o.i = l.i + 1 AND o.source = s.mid
    QUALIFY row_number() OVER (PARTITION BY l.conv_id, o.after ORDER BY l.cost + more + o.cost, l.audit || edits || o.op) = 1
  )
), solved AS (
  SELECT l.conv_id, l.cost + more AS cost, l.audit || edits AS audit, {lines} AS lines
  FROM layer l JOIN counted c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.n = l.i JOIN inserts s ON s.source = l.state AND s.mid IN {ACCEPTED}
  QUALIFY row_number() OVER (PARTITION BY l.conv_id ORDER BY l.cost + more, l.audit || edits) = 1
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def inserted_roles(state: int, n: int) -> list[str]:
    """The roles of so many rows that are inserted from a state on."""
    out = []
    for _ in range(n):
        out.append(ROLES[NEXT[state]])
        state = STEPS[state, NEXT[state]]
    return out
