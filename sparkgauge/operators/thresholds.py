"""Threshold rules: match, strictest, exceeded, and the filters that follow from them.

Rules hold for a type name by its prefix and suffix, which is no equality.  Up to TRIE letters
of rules go to every executor as a trie of prefixes, at whose nodes tries of reversed suffixes
hang; each node has the least threshold of its rules.  A name is walked once, and at each of
its beginnings that bears suffixes once more from its end, whatever the number of rules.  More
rules are met by equality of both parts at once: for each pair of lengths that rules have, a name brings its
beginning and its end, so that it never meets a rule that does not hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of rules, and one for each rule, whose trie goes to every executor (some 130 bytes a letter); more are joined by exchange.
TRIE = 1_500_000
#: More than any character's number.
CHARACTERS = 1 << 21


class RuleTrie:
    """The least threshold of the rules that hold for a name."""

    def __init__(self, rules: Iterable[tuple[str | None, str | None, int]]):
        self.next: dict[int, int] = {}  # by node and character as one number
        self.least: list[int | None] = [None]
        self.ends: dict[int, int] = {}  # where the suffixes of a node of prefixes begin
        for prefix, suffix, threshold in rules:
            if prefix is None and suffix is None:
                continue
            at = self.grown(0, prefix or "")
            if suffix is not None:
                if at not in self.ends:
                    self.ends[at] = len(self.least)
                    self.least.append(None)
                at = self.grown(self.ends[at], reversed(suffix))
            known = self.least[at]
            self.least[at] = threshold if known is None else min(known, threshold)

    def grown(self, at: int, letters: Iterable[str]) -> int:
        for c in letters:
            step = at * CHARACTERS + ord(c)
            if step not in self.next:
                self.next[step] = len(self.least)
                self.least.append(None)
            at = self.next[step]
        return at

    def walked(self, at: int, letters: Iterable[str]) -> Iterator[int]:
        yield at
        for c in letters:
            found = self.next.get(at * CHARACTERS + ord(c))
            if found is None:
                return
            at = found
            yield at

    def strictest(self, name: str) -> int | None:
        found = []
        for node in self.walked(0, name):
            found.append(self.least[node])
            if node in self.ends:
                found += [self.least[end] for end in self.walked(self.ends[node], reversed(name))]
        return min((x for x in found if x is not None), default=None)


def matches(type_name: Column, prefix: Column, suffix: Column) -> Column:
    """Whether a rule holds for a type name: both parts where both are given, never without any."""
    given = prefix.isNotNull() | suffix.isNotNull()
    return given & (prefix.isNull() | F.startswith(type_name, prefix)) & (suffix.isNull() | F.endswith(type_name, suffix))


def strictest(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(_type, _strictest): the least threshold of the rules that hold, for every name that has one; rules are (_prefix, _suffix, _threshold)."""
    rules = rules.where("_threshold is not null and (_prefix is not null or _suffix is not null)").groupBy("_prefix", "_suffix").agg(F.min("_threshold").alias("_threshold"))
    letters = F.sum(F.lit(1) + F.length(F.coalesce("_prefix", F.lit(""))) + F.length(F.coalesce("_suffix", F.lit(""))))
    if (rules.agg(letters).first()[0] or 0) <= TRIE:
        trie = names.sparkSession.sparkContext.broadcast(RuleTrie(map(tuple, rules.select("_prefix", "_suffix", "_threshold").collect())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([trie.value.strictest(n) for n in b.column(0).to_pylist()], pa.int32())], ["_type", "_strictest"])

        return names.select("_type").mapInArrow(run, "_type string, _strictest int").where("_strictest is not null")
    prefix, suffix = F.coalesce("_prefix", F.lit("")), F.coalesce("_suffix", F.lit(""))  # an empty part holds for every name, like none
    rules = rules.groupBy(prefix.alias("_prefix"), suffix.alias("_suffix")).agg(F.min("_threshold").alias("_threshold"))
    pairs = rules.groupBy(F.length("_prefix").alias("_m")).agg(F.collect_set(F.length("_suffix")).alias("_ends"))  # a row for each length of prefixes
    sizes = names.select("_type", F.explode(F.expr("sequence(0, length(_type))")).alias("_m")).join(F.broadcast(pairs), "_m")
    parts = sizes.select("_type", "_m", F.explode("_ends").alias("_n")).where("_n <= length(_type)")
    parts = parts.select("_type", F.expr("left(_type, _m)").alias("_prefix"), F.expr("right(_type, _n)").alias("_suffix"))
    both = parts.join(rules, ["_prefix", "_suffix"])
    return both.groupBy("_type").agg(F.min("_threshold").alias("_strictest"))


def with_threshold(functions: DataFrame, rules: DataFrame | None, fallback: int | None = None, default: int | None = None, type_col: str = "enclosing_type") -> DataFrame:
    """Adds ``threshold``: the least of the matching rules, else the fallback, else the default, else null."""
    rest = F.coalesce(F.lit(fallback).cast("int"), F.lit(default).cast("int"))
    if rules is None:
        return functions.withColumn("threshold", rest)
    # distinct names meet the rules, each once
    names = functions.select(F.col(type_col).alias("_type")).where("_type is not null").distinct()
    r = rules.select(F.col("prefix").alias("_prefix"), F.col("suffix").alias("_suffix"), F.col("threshold").alias("_threshold"))
    out = functions.join(strictest(names, r), functions[type_col] == F.col("_type"), "left")
    return out.withColumn("threshold", F.coalesce(F.col("_strictest"), rest)).drop("_type", "_strictest")


def exceeds(cyclomatic: Column, cognitive: Column, threshold: Column) -> Column:
    """Whether either metric reaches the threshold; never without one."""
    return F.coalesce(F.greatest(cyclomatic, cognitive) >= threshold, F.lit(False))


def exceeding(functions: DataFrame) -> DataFrame:
    return functions.where(exceeds(F.col("cyclomatic"), F.col("cognitive"), F.col("threshold")))


def any_exceeded(functions: DataFrame) -> DataFrame:
    """One row: whether any function exceeds its threshold."""
    hit = exceeds(F.col("cyclomatic"), F.col("cognitive"), F.col("threshold"))
    return functions.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("exceeded"))
