"""Secrets in texts: three fixed patterns, and two character Markov models for what the patterns miss.

Everything is a SQL expression over one row, so a scan of the documents needs no shuffle and no Python worker. One model
learns the transitions of characters in random strings, the other those in ordinary identifiers. Labelled samples come
from the documents themselves: values that a pattern matched are random strings, other long words are identifiers.
A long word is reported if its log-likelihood ratio reaches a bound.

Positions are code points. Spark tells what a pattern matches but not where, so the text before each match is matched too and
the lengths are summed up.
"""

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from recordrisk.llm.shared import texts

# Kinds in their order, with pattern, the group that is the secret, and its least length.
PATTERNS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
               r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f]+ that are long enough
]
# Strings of which one must occur for a kind to match: they spare most texts the pattern.
HINTS = {"assign": [":", "="], "access": ["AKIA"]}
METHOD = "random"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
WORD = r"[A-Za-z0-9+/_.=-]"
SIZE = len(ALPHABET)
SCALE = 1_000_000  # weights are whole millionths of a nat, so that sums are exact


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sum_before(steps: Column) -> Column:
    """Sums of all earlier elements of an array of longs, in n * sqrt(n) steps and within the row."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def sums(steps, width):
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(steps) / width).cast("int") - 1),
                             lambda b: total(F.slice(steps, b * width + 1, width)))
        return let(blocks, lambda blocks: let(
            F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b))),
            lambda heads: F.transform(steps, lambda _, i: F.get(heads, F.floor(i / width).cast("int"))
                                      + total(F.slice(steps, F.floor(i / width).cast("int") * width + 1, i % width)))))

    none = F.array().cast("array<bigint>")
    return let(steps, lambda s: F.when(F.size(s) == 0, none).otherwise(
        let(F.ceil(F.sqrt(F.size(s).cast("double"))).cast("int"), lambda width: sums(s, width))))


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """(start, kind, end, value) of the leftmost non-overlapping matches whose group is long enough."""
    schema = "array<struct<start:bigint,kind:string,end:bigint,value:string>>"

    def found(gaps, whole, values):
        steps = F.zip_with(gaps, whole, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        return let(sum_before(steps), lambda at: F.transform(
            whole, lambda m, i: let(F.get(at, i) + F.length(F.get(gaps, i)), lambda start: F.struct(
                start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), F.get(values, i).alias("value")))))

    # each match goes on where the last one ended (\\G) and takes the text before it along, so lengths give its place
    part = lambda i: F.regexp_extract_all(text, F.lit(rf"\G(?s)(.*?)({pattern})"), F.lit(i))
    spans = let(part(1), lambda gaps: let(part(2), lambda whole: (
        let(part(group + 2), lambda values: found(gaps, whole, values)) if group else found(gaps, whole, whole))))
    hints = [text.contains(h) for h in HINTS.get(kind, [])]
    can = text.rlike(pattern)
    if hints:
        can = reduce(or_, hints) & can
    return F.when(can, F.filter(spans, lambda m: F.length(m["value"]) >= least)).otherwise(F.array().cast(schema))


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by kind and place."""
    return F.concat(*[matches(text, *p) for p in PATTERNS])


def long_words(text: Column, least: int) -> Column:
    """Spans of the words of the alphabet that have ``least`` characters."""
    return matches(text, METHOD, f"{WORD}{{{least},}}", 0, least)


def outside(words: Column, base: Column) -> Column:
    """Words that share no character with a base span."""
    return F.filter(words, lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))


def codes(word: Column) -> Column:
    """Numbers of a word's characters in the alphabet."""
    return F.transform(F.regexp_extract_all(word, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


@dataclass
class SecretModel:
    """Weights of the transitions, a row per former character and a last row for the first one of a word."""

    weights: list  # (SIZE + 1) * SIZE whole numbers: millionths of a nat in favour of a random string
    least: int

    def ratio(self, word: Column) -> Column:
        """Log-likelihood ratio of a word in millionths of a nat."""
        table = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<bigint>")  # folded to a constant
        start = F.lit(SIZE * SIZE)
        return let(codes(word), lambda c: F.aggregate(
            F.sequence(F.lit(1), F.size(c) - 1), F.get(table, start + F.get(c, F.lit(0))),
            lambda a, i: a + F.get(table, F.get(c, i - 1) * SIZE + F.get(c, i))))


def samples(docs: DataFrame, least: int) -> DataFrame:
    """(random, word, n): the values of base spans, and the other long words with a letter that occur more than once, as
    words do and keys hardly ever do."""
    text = F.col("text")
    rows = texts(docs).select("text", base_spans(text).alias("base"))
    plainly = F.regexp_extract_all(text, F.lit(f"{WORD}{{{least},}}"), F.lit(0))
    words = F.when(F.size("base") == 0, plainly).otherwise(
        F.transform(outside(long_words(text, least), F.col("base")), lambda w: w["value"]))
    kept = F.concat(F.transform("base", lambda b: F.struct(F.lit(True).alias("random"), b["value"].alias("word"))),
                    F.transform(words, lambda w: F.struct(F.lit(False).alias("random"), w.alias("word"))))
    counted = rows.select(F.inline(kept)).groupBy("random", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("random") | ((F.col("n") > 1) & F.col("word").rlike("[A-Za-z]")))


def fit_secrets(docs: DataFrame, least: int = 16, word_least: int = 8) -> SecretModel:
    """Learns both models from all documents: random strings are the values of base spans, identifiers all other words
    of ``word_least`` characters with a letter that occur twice or more. Without any sample no word differs from another.
    The driver gets the counts of 2 * 69 * 68 transitions at most, whatever the data.
    """
    # distinct words only: a copied secret or a frequent word says no more about its characters
    pairs = samples(docs, word_least).select(
        "random", F.explode(let(codes(F.col("word")), lambda c: F.transform(
            c, lambda x, i: F.when(i == 0, F.lit(SIZE)).otherwise(F.get(c, i - 1)) * SIZE + x))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    return SecretModel(weights_of(counts), least)


def weights_of(counts: dict) -> list:
    """Logarithms of the ratios of the transition probabilities, in whole millionths.

    A random string goes on with what followed in the samples or with any character, either half of the time, so that
    many keys of one shape don't hide those of another. An identifier's counts are each raised by one.
    """
    out = []
    for former in range(SIZE + 1):
        row = range(former * SIZE, (former + 1) * SIZE)
        yes_all, no_all = (sum(counts.get((kind, p), 0) for p in row) for kind in (True, False))
        for p in row:
            yes, no = counts.get((True, p), 0), counts.get((False, p), 0)
            learnt = yes * SIZE + yes_all if yes_all else 2  # over 2 * SIZE * yes_all, or over 2 * SIZE
            out.append(round(SCALE * (math.log(learnt) - math.log(2 * SIZE * max(yes_all, 1)) - math.log(no + 1) + math.log(no_all + SIZE))))
    return out


def find_secrets(docs: DataFrame, model: SecretModel, bound: float = 0.75) -> DataFrame:
    """doc_id, text_spans: an array of (start, kind, end, value) by start, then kind as listed, for every row.

    Spans are code points, ends exclusive. Kind ``random`` marks words of ``model.least`` characters with a letter that
    share nothing with another span and whose log-likelihood ratio is ``bound`` nats a character or more. Null texts count as
    empty; rows with null or repeated ids are looked at one by one; an empty table gives an empty one, other columns are left
    behind.
    """
    rank = F.create_map(*[x for i, (k, *_) in enumerate([*PATTERNS, (METHOD,)]) for x in (F.lit(k), F.lit(i))])
    both = texts(docs).select("doc_id", base_spans(F.col("text")).alias("base"), long_words(F.col("text"), model.least).alias("words"))
    some = F.filter(outside(F.col("words"), F.col("base")),
                    lambda w: w["value"].rlike("[A-Za-z]") & (model.ratio(w["value"]) >= F.length(w["value"]).cast("long") * int(bound * SCALE)))
    ordered = F.sort_array(F.transform(F.concat("base", some), lambda s: F.struct(
        s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    return both.select("doc_id", F.transform(ordered, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))).alias("text_spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, model: SecretModel, bound: float = 0.75) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row; see ``find_secrets``."""
    found = find_secrets(docs, model, bound)
    of = lambda kind: F.size(F.filter("text_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("text_spans", lambda s: s["kind"] != METHOD)
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k, *_ in PATTERNS],
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("text_spans")).alias("spans"))
