"""Rules as a table: literals that a match needs, every pattern against every text by brute force; deep pages."""
import datetime
import random
import re
from re import _parser

import pytest
from pyspark.sql import functions as F

from proofline import session
from proofline.functions.regex import alternatives
from proofline.operators import paging
from proofline.operators import rules as RL


@pytest.mark.parametrize("pattern, literals", [
    (r"hallucin|fabricat|invent", ["hallucin", "fabricat", "invent"]), (r"cit(e|es|ed|ation)", ["cit"]), (r"\bpii\b|a.*info", ["pii", "info"]),
    (r"(?:abc)+de", ["abc"]), (r"(abc)?x*", []), (r"a|long", ["a", "long"]), (r"JSON\b schema", ["json schema"]), (r"[ab]{3}", []),
    (r"ab(?=cd)cde", ["abcde"]), (r"é+abc", ["abc"]), ("", [])])
def test_literals_that_a_match_needs(pattern, literals):
    assert sorted(RL._needed(_parser.parse(pattern))) == sorted(literals)


PATTERNS = [r"hallucin|fabricat|invent", r"\bpii\b|personal.*info", r"p9\d|under \d", r"a.c", r"x*", r"task", r"(red|blu) ?widg", r"k[ıi]ng|sister",
            r"foo-bar", r"e{2}", r"^line", r"(?P<w>\w{3}) (?P=w)", r"absent words", r"MASK"]


def test_every_rule_is_found_as_by_search(spark):
    rng = random.Random(5)
    words = ["Hallucinate", "invent", "PII", "personal", "info", "p95", "under 5", "abc", "task", "red widget", "bluWIDG", "taſk", "KING",
             "foo-bar", "see", "line", "the the", "été", "\n", "maſK"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(150)] + [None, "", "invent " * 3000, "tas" * 5]
    rules = [(f"r{i}", p) for i, p in enumerate(PATTERNS)] + [("same", PATTERNS[5]), ("bad", "(("), ("none", None)]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    r = spark.createDataFrame(rules, "rule_id string, pattern string")
    assert {x.rule_id for x in RL.read_rules(r).where("reason is not null").collect()} == {"bad", "none"}
    got = [tuple(x) for x in RL.match_rules(t, r, ["doc_id"]).collect()]
    want = {(i, k) for i, x in enumerate(texts) if x is not None for k, p in rules if k not in ("bad", "none") and re.search(p, x, re.I)}
    assert len(got) == len(set(got)) and set(got) == want
    assert RL.match_rules(t.where("false"), r, ["doc_id"]).count() == 0 and RL.match_rules(t, r.where("false"), ["doc_id"]).count() == 0


def test_no_rule_meets_every_text(spark):
    t = spark.createDataFrame([(1, "red widget")], "doc_id long, text string")
    r = spark.createDataFrame([("a", "widget")], "rule_id string, pattern string")
    plan = RL.match_rules(t, r, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def listing(spark, n=3000):
    """Many rows at one moment, some without time or id."""
    rng = random.Random(3)
    day = datetime.datetime(1970, 1, 1)
    rows = [(i, day + datetime.timedelta(microseconds=0 if i % 3 == 0 else rng.randint(-10**15, 10**15))) for i in range(-n // 2, n // 2)]
    rows += [(10**6 + i, None) for i in range(40)] + [(None, day)]
    return spark.createDataFrame(rows, "report_id long, created_at timestamp").repartition(6)


def test_pages_at_any_depth(spark):
    df = listing(spark).cache()
    order = [F.desc("created_at"), F.desc("report_id")]
    whole = [tuple(r) for r in df.orderBy(*order).collect()]
    args = ("created_at", "report_id")
    for page_no in (0, 1, 17, 30, 31, 40, len(whole) // 50, 70):
        got = [tuple(r) for r in paging.page(df, page_no, 50, *args, enough=60, bins=8).collect()]
        assert got == whole[page_no * 50:page_no * 50 + 50], page_no
    for place in (0, 1500, 1999, len(whole) - 45, len(whole) - 20, len(whole) - 1):
        last = (whole[place][1], whole[place][0])
        assert [tuple(r) for r in paging.page_after(df, last, 50, *args).collect()] == whole[place + 1:place + 51], place
    with pytest.raises(TypeError):
        paging.page(df.withColumn("created_at", F.lit("x")), 99, 50, *args, enough=1)


def test_a_deep_page_sorts_few_rows(spark):
    df = spark.range(200_000).selectExpr("id as report_id", "timestamp_micros(id * 7919 % 100003 * 1000000) as created_at")
    numbers = [paging._ordinal(df, c)[0] for c in ("created_at", "report_id")]
    places = paging._Places(df, numbers, 1000, 64)
    lo, hi, before = places.find(100_000)
    inside = df.where(paging._at_most(numbers, hi)).where(~paging._at_most(numbers, lo, strict=True)).count()
    assert inside <= 1000 and before <= 100_000 < before + inside


def test_parts_inside_a_word_are_tried_on_words():
    part = {p: RL._part(p)["word"] for p in (r"\ban[a-z]b\b", r"(red|rin)(ly|tion)", r"\w+\d", "a.c", "red ring", "x*", "[^a]bc", r"^abc", "[A-z]b", "é", r"a(?=b)")}
    assert [p for p, word in part.items() if word] == [r"\ban[a-z]b\b", r"(red|rin)(ly|tion)", r"\w+\d"]
    assert [(x["word"], x["sets"]) for x in RL._read([r"\bred[a-z]*ri|red ring", "blu[a-z]* rod"]).parts.explode()] == [
        (True, [["red"]]), (False, [["ring"], ["red"]]),
        (False, [["blu"], ["rod"]])]


@pytest.mark.parametrize("pattern, parts", [
    ("a|b", ["a", "b"]), ("(a|b)c|[|)]d", ["(a|b)c", "[|)]d"]), (r"a\|b|c", [r"a\|b", "c"]), ("[]|]x|y", ["[]|]x", "y"]), ("[^]|]x|y", ["[^]|]x", "y"]),
    ("(?i)a|b", ["(?i)a|b"]), (r"(x)|\1y", [r"(x)|\1y"]), ("(?#|)a|b", ["(?#|)a|b"]), ("a|", ["a", ""]), ("(?:a|b)|c", ["(?:a|b)", "c"])])
def test_outermost_alternatives(pattern, parts):
    assert alternatives(pattern) == parts


def test_texts_of_one_name_and_words_of_every_script(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 5)
    monkeypatch.setattr(RL, "SENT_ROWS", 0)
    texts = [(1, "red ring"), (1, "red ring"), (1, "no ringtion"), (None, "anvb"), (2, "ANvB_ anvb"), (3, "été1 e\u0301t"), (4, "_"), (5, "ring red"), (6, "taſk")]
    rules = [(p, p) for p in (r"\ban[a-z]b\b", "red ring", "(red|rin)[a-z]*|red ring", r"\w\d", "[a-f_]", "TASK", r"r\b", r"\Bg")]
    t = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    r = spark.createDataFrame(rules, "rule_id string, pattern string")
    out = RL.match_rules(t, r, ["doc_id"])
    want = sorted((str(i), p) for i, x in texts for p, _ in rules if re.search(p, x, re.I))
    assert sorted((str(a), b) for a, b in out.collect()) == want
