"""Keyword rules that are rows of a table (JON-9, TXT-2): texts against thousands of patterns.

A regular expression cannot be an equi-join key, but texts share their words. Each rule is cut at its outermost ``|``
into parts, and each part read once. A part that holds nothing but word characters (``\\bcit(e|ed)\\b``) is found in a
text just where it is found in one of its words, so it is tried on the vocabulary, the distinct words of all texts, which
grows slower than they do. Most others name literals without which they cannot match: a piece of each of them lies inside
one word, so texts meet a part only if they hold a word for every such set of literals, and what meets is verified by the
pattern itself. Literals are looked up in the vocabulary: each stands under the one of its grams that
fewest words hold, and meets the words with that gram. There are at most 36 ** 3 + 36 ** 2 grams, so a table of distinct
grams may be broadcast, whatever the number of texts or rules. Parts without such a literal (``a.*b``) are tried on
every text, in blocks.
"""
from __future__ import annotations

import re
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from proofline.functions.regex import alternatives, inside_a_word, needed_sets, shortest, to_java
from proofline.functions.regex import needed as _needed
from proofline.operators.testsets import BASELINES
from proofline.session import checkpoint_dir, partitions_for

__all__ = ["_needed", "match_rules", "read_rules", "rule_intents"]

# the shortest literal looked up for a part that is tried on texts, on words; the longest gram
GRAM = 3
WORD_GRAM = 2
SALTS = 16
# words of interest up to which they are sent to every task instead of meeting the words of all texts in a shuffle
SENT_ROWS = 300_000
# sets of literals of a part, one bit each
MAX_SETS = 60
# case-insensitive search as Python's re.search(p, s, re.I): Unicode classes, "\n" alone ends a line
RULE_FLAGS = "(?iUd)"
# the characters outside ASCII that match an ASCII letter when case is ignored
SAME_LETTER = ("ſKıİ", "skii")
_READ = "parts array<struct<java string, word boolean, sets array<array<string>>>>, reason string"


def _pieces(literal: str) -> list[str]:
    """The parts of a literal that are made of the index's characters."""
    return re.split("[^a-z0-9]+", literal)


def _sets(parsed, least: int) -> list[list[str]]:
    """Sets of literals of which a match needs one each, inside words, none shorter than ``least``."""
    out = []
    for found in needed_sets(parsed):
        ways = [[x] for x in _pieces(found[0])] if len(found) == 1 else [[max(_pieces(x), key=len) for x in found]]
        out += [sorted(set(w)) for w in ways if shortest(w) >= least]
    return sorted({tuple(x) for x in out}, key=lambda x: (-shortest(x), x))[:MAX_SETS]


def _part(pattern: str) -> dict:
    parsed = _parser.parse(pattern)
    word = inside_a_word(parsed)
    sets = _sets(parsed, WORD_GRAM)[:1] if word else _sets(parsed, GRAM)
    return {"java": RULE_FLAGS + to_java(pattern), "word": word, "sets": [list(x) for x in sets]}


def _read(patterns: pd.Series) -> pd.DataFrame:
    rows = []
    for p in patterns:
        try:
            _parser.parse(p)
            rows.append(([_part(x) for x in alternatives(p)], None))
        except (re.error, TypeError, OverflowError, RecursionError) as e:
            rows.append((None, f"invalid pattern: {e}"))
    return pd.DataFrame(rows, columns=["parts", "reason"])


def read_rules(rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """The rules with ``parts`` (of each its pattern for ``rlike``, whether it lies inside a word, the literals it
    needs) and ``reason`` where the pattern is null or does not parse."""
    return rules.withColumn("_r", pandas_udf(_read, _READ)(F.coalesce(pattern, F.lit("(")))).select(
        *rules.columns, "_r.parts",
        F.when(F.col(pattern).isNull(), "invalid pattern: none given").otherwise(F.col("_r.reason")).alias("reason"))


def words(text: Column) -> Column:
    """The distinct words of a text."""
    return F.filter(F.array_distinct(F.split(text, r"(?U)\W+")), lambda w: w != "")


def folded(word: Column) -> Column:
    """A word with case and the look-alikes of ASCII letters folded."""
    return F.lower(F.translate(word, *SAME_LETTER))


def grams(word: Column, n: int) -> Column:
    """The distinct grams of n characters of a word."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))
    return F.when(F.length(word) >= n, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _holding(vocabulary: DataFrame, literals: DataFrame) -> DataFrame:
    """(_literal, _word): the words that hold each literal."""
    gram = F.when(F.length("_literal") >= GRAM, grams(F.col("_literal"), GRAM)).otherwise(grams(F.col("_literal"), WORD_GRAM))
    literal = literals.select("_literal", F.explode(gram).alias("_gram"))
    both = F.concat(grams(F.col("_folded"), GRAM), grams(F.col("_folded"), WORD_GRAM))
    held = (vocabulary.select("_word", folded(F.col("_word")).alias("_folded")).select("_word", "_folded", F.explode(both).alias("_gram"))
            .join(F.broadcast(literal.select("_gram").distinct()), "_gram", "left_semi").checkpoint())  # read twice
    sizes = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_words"))
    # a literal with a gram that no word holds is in no text
    index = (literal.join(sizes, "_gram", "left").groupBy("_literal").agg(
        F.min_by("_gram", F.struct(F.coalesce("_words", F.lit(0)), "_gram")).alias("_gram"),
        F.min(F.coalesce("_words", F.lit(0))).alias("_least")).where("_least > 0").drop("_least"))
    return held.join(index, "_gram").where(F.contains(F.col("_folded"), F.col("_literal"))).select("_literal", "_word").distinct()


def _tried(rows: DataFrame, column: str, by: Column, parts: DataFrame, rule: str, keep: str) -> DataFrame:
    """(keep, rule): every row against every part, each block of rows with its copy of the parts."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = parts.select(rule, "java", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    return (rows.withColumn("_block", F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int"))
            .join(copies.hint("shuffle_hash"), "_block").where(F.expr(f"{column} rlike java")).select(keep, rule))


def match_rules(texts: DataFrame, rules: DataFrame, on: list[str], text: str = "text", rule: str = "rule_id") -> DataFrame:
    """(``on``, ``rule``) of every text that a rule's pattern is found in, each once. ``on`` names a
    text, ``rule`` a rule; a null text and a rule with a ``reason`` match nothing."""
    spark = texts.sparkSession
    checkpoint_dir(spark)
    known = (rules if "parts" in rules.columns else read_rules(rules)).where("reason is null").select(
        rule, F.posexplode("parts").alias("_part", "_p")).select(rule, "_part", "_p.*").checkpoint()
    # texts of one name are told apart by their content
    body = texts.where(F.col(text).isNotNull()).select(
        F.struct(*on, F.xxhash64(text).alias("_hash"), F.length(text).alias("_length")).alias("_k"), F.col(text).alias("_text"))
    vocabulary = body.select(F.explode(words(F.col("_text"))).alias("_word")).groupBy("_word").agg(
        F.count(F.lit(1)).alias("_texts")).checkpoint()
    # as many partitions as the words of all texts need
    n = partitions_for(spark, vocabulary.agg(F.sum("_texts")).first()[0] or 0)
    seek = known.select(rule, "_part", "java", "word", F.size("sets").alias("_n"), F.posexplode("sets").alias("_set", "_ways"))
    seek = seek.select(*[c for c in seek.columns if c != "_ways"], F.explode("_ways").alias("_literal"))
    holding = _holding(vocabulary, seek.select("_literal").distinct()).checkpoint()
    # parts inside a word: the words they are found in
    inside = (seek.where("word").join(holding, "_literal").select(rule, "java", "_word").distinct()
              .where(F.expr("_word rlike java")).select("_word", rule))
    free = known.where(F.size("sets") == 0)
    everywhere = {r.word for r in free.select("word").distinct().collect()}  # at most two rows
    if True in everywhere:
        inside = inside.unionByName(_tried(vocabulary, "_word", F.col("_word"), free.where("word"), rule, "_word"))
    # what a word of a text says: a part inside it is found (part -1), or one set of a part has its literal
    met = inside.distinct().select("_word", rule, F.lit(-1).alias("_part"), F.lit(1).alias("_n"), F.lit(0).alias("_set")).unionByName(
        seek.where("not word").join(holding, "_literal").select("_word", rule, "_part", "_n", "_set").distinct())
    met = met.checkpoint()
    post = body.select("_k", F.explode(words(F.col("_text"))).alias("_word"))
    if met.count() <= SENT_ROWS:
        pairs = post.join(F.broadcast(met), "_word")
    else:
        # a frequent word is spread over salts
        salted = met.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = (post.withColumn("_salt", F.pmod(F.xxhash64("_k"), F.lit(SALTS)).cast("int")).repartition(n, "_word", "_salt")
                 .join(salted.repartition(n, "_word", "_salt"), ["_word", "_salt"]))
    sets = F.bit_count(F.bit_or(F.expr("shiftleft(1L, _set)")))
    full = (pairs.repartition(n, "_k").groupBy("_k", rule, "_part", "_n").agg(sets.alias("_have"))
            .where("_have = _n").select("_k", rule, "_part").checkpoint())
    found = full.where("_part < 0").select("_k", rule).unionByName(
        full.where("_part >= 0").join(known.select(rule, "_part", "java"), [rule, "_part"]).join(body, "_k")
        .where(F.expr("_text rlike java")).select("_k", rule))
    if False in everywhere:
        found = found.unionByName(_tried(body, "_text", F.col("_k"), free.where("not word"), rule, "_k"))
    found = found.repartition(n, "_k").distinct()
    return found.join(body.select("_k").repartition(n, "_k"), "_k").select(*[F.col("_k")[c].alias(c) for c in on], rule)


def rule_intents(reqs: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """TXT-2 with the rules as a table (rule_id, pattern, suffix, category, assertion, how, template,
    params, threshold): one intent per requirement and rule found in it; a requirement list in
    which no rule is found gets the two baselines on its first item."""
    hits = match_rules(reqs, rules, [key, "req_id"]).checkpoint()
    payload = ["category", "assertion", "how", "template", "params", "threshold"]
    intents = hits.join(rules, "rule_id").select(key, "req_id", "suffix", *payload)
    base = F.array(*[F.struct(
        F.lit(s).alias("suffix"), F.lit(c).alias("category"), F.lit(a).alias("assertion"), F.lit("template").alias("how"),
        F.lit(t).alias("template"), F.lit(p).alias("params"), F.lit(None).cast("double").alias("threshold"))
        for s, c, a, t, p in BASELINES])
    none = reqs.where("position = 1").join(hits.select(key).distinct(), key, "left_anti").select(key, "req_id", F.inline(base))
    return intents.unionByName(none).select(
        key, F.concat(F.lit("H-"), "req_id", F.lit("-"), "suffix").alias("intent_id"), F.col("req_id").alias("requirement_ref"), *payload)
