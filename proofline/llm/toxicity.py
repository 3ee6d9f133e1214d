"""Toxicity scores: gradient-boosted trees over dense features, calibrated isotonically.

Features of a whole text, all rates per word or letter: density of a fixed insult lexicon and
of a learned one (words and word beginnings much more frequent in toxic training texts, with
their mean log odds), insults near a second-person word, second-person words, capitals, words
in capitals, punctuation, exclamation and question marks, digits, obfuscated words (letters
replaced or split by signs) and those that hide an insult, stretched letters, length.

Training reads at most ``TRAIN_ROWS`` labelled rows (those with the smallest hash of their id)
and splits them by another hash: two fifths for the learned lexicon (``LEXICON`` entries at
most), two fifths for the trees, one fifth for the calibration.

Defined results: null and empty texts have all features zero and get the score of those; ids
labelled more than once count once per label row; labels without a document or value are not
used; without both classes in every part the score is the share of toxic labels (0 without
labels); repeated rows are scored each; an empty table gives no rows.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import held_out, whole_text, written

TRAIN_ROWS = 12_000
LEXICON = 3000
MIN_TOXIC_DOCS = 4     # toxic training texts a learned entry occurs in, at least
MIN_LOG_ODDS = 2.0
NEAR = 5               # words between an insult and a second-person word, at most
TOXIC_FROM = 0.7
FOLDS, HELD_OUT = 3, 1
PREFIXES = (4, 6)      # lengths of the word beginnings that are candidates too

# Insults, second-person words and look-alike signs.
INSULTS = """
idiot idiots idiotic moron morons moronic stupid dumb dumbass fool fools imbecile loser losers
scum trash garbage worthless pathetic disgusting clown clowns pig pigs bastard bastards bitch
bitches asshole assholes jerk jerks shit bullshit crap fuck fucking fucked fucker cunt dick
whore slut retard retarded freak creep creeps vermin filth filthy lowlife scumbag jackass
douche coward cowards liar ugly hate kill die
dummkopf arschloch trottel depp vollidiot abschaum miststück schwachkopf
crétin connard salaud imbécile débile ordure abruti
imbécil estúpido estúpida basura asqueroso asquerosa cabrón tonto
""".split()
SECOND_PERSON = """
you your yours yourself yourselves u ur you're youre
du dich dir dein deine deiner deinem deinen ihr euch euer eure
tu te toi ton ta tes vous votre vos
tú ti tus usted ustedes vosotros vuestro vuestra
""".split()
LOOKALIKES = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "|": "l", "0": "o", "$": "s",
              "5": "s", "7": "t", "+": "t"}

NAMES = ("insults", "distinct_insults", "learned", "learned_odds", "learned_count", "near_you",
         "you", "capitals", "shouted", "punctuation", "marks", "digits", "obfuscated",
         "hidden_insults", "stretched", "log_words")

_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 sign, 5 ! or ?
for _c in range(256):
    if chr(_c) in "!?":
        _KIND[_c] = 5
    elif chr(_c) in _SIGNS:
        _KIND[_c] = 4
    elif 65 <= _c <= 90:
        _KIND[_c] = 1
    elif 97 <= _c <= 122 or _c >= 0xC3:
        _KIND[_c] = 2
    elif 48 <= _c <= 57:
        _KIND[_c] = 3
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_UNMASK = str.maketrans(LOOKALIKES)


@dataclass
class Lexicon:
    insults: frozenset = frozenset(INSULTS)
    you: frozenset = frozenset(SECOND_PERSON)
    learned: dict = field(default_factory=dict)  # word, or beginning followed by *, -> log odds


def features(text: str, lex: Lexicon) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    kinds = np.zeros(6, np.int64)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    for i in range(0, len(raw), 1 << 20):
        kinds += np.bincount(_KIND[raw[i:i + (1 << 20)]], minlength=6)
    shouted = sum(1 for w in words if len(w) > 2 and w.isupper())
    insult_at, you_at, distinct = [], [], set()
    obfuscated = hidden = learned = 0
    odds = 0.0
    insults, you, known = lex.insults, lex.you, lex.learned
    for i, w in enumerate(text.lower().split()):
        if not w.isalpha():
            w = w.strip(_SIGNS)
            if not w.isalpha() and w and any(c.isalpha() for c in w):
                bare = "".join(c for c in w.translate(_UNMASK) if c.isalpha())
                if w.translate(_UNMASK) != w or not w.replace("'", "").replace("-", "").isalpha():
                    obfuscated += 1
                if bare in insults and w not in insults:
                    hidden += 1
                    w = bare
        if w in insults:
            insult_at.append(i)
            distinct.add(w)
        elif w in you:
            you_at.append(i)
        if known:
            best = max([known.get(w, 0.0), *(known.get(w[:k] + "*", 0.0) for k in PREFIXES)])
            if best:
                learned += 1
                odds += best
    near = 0
    if insult_at and you_at:
        at = np.array(you_at)
        p = np.searchsorted(at, insult_at)
        lo = np.abs(at[np.maximum(p - 1, 0)] - insult_at)
        hi = np.abs(at[np.minimum(p, len(at) - 1)] - insult_at)
        near = int((np.minimum(lo, hi) <= NEAR).sum())
    letters, size = max(kinds[1] + kinds[2], 1), len(raw)
    return [len(insult_at) / n, float(len(distinct)), learned / n, odds / max(learned, 1),
            float(np.log1p(learned)), near / n, len(you_at) / n, kinds[1] / letters, shouted / n,
            (kinds[4] + kinds[5]) / size, kinds[5] / size, kinds[3] / size, obfuscated / n,
            hidden / n, len(_STRETCHED.findall(text)) / n, float(np.log1p(n))]


def feature_column(lex: Lexicon, text: Column, spark) -> Column:
    shared = spark.sparkContext.broadcast(lex)

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[float(x) for x in features(t.as_py(), shared.value)] for t in texts],
                        pa.list_(pa.float64()))
    return run(whole_text(text))


def _beginnings(words: Column, k: int) -> Column:
    longer = F.filter(words, lambda x: F.length(x) > k)
    return F.transform(longer, lambda x: F.concat(x.substr(1, k), F.lit("*")))


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> Lexicon:
    """``rows``: text, toxic. Entries by document counts; what is collected is bounded."""
    word = F.array_distinct(F.transform(
        F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", "")))
    longer = [_beginnings(F.col("w"), k) for k in PREFIXES]
    terms = rows.select("toxic", word.alias("w")).select(
        "toxic", F.explode(F.array_distinct(F.concat("w", *longer))).alias("term")).where("term <> ''")
    both = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, clean = (both[0] or 0) + 2, both[1] - (both[0] or 0) + 2
    n = F.count(F.lit(1)) - F.sum("toxic")
    best = (terms.groupBy("term").agg(F.sum("toxic").alias("t"), n.alias("c"))
            .where(F.col("t") >= MIN_TOXIC_DOCS)
            .withColumn("odds", F.log((F.col("t") + 1) / toxic) - F.log((F.col("c") + 1) / clean))
            .where(F.col("odds") >= MIN_LOG_ODDS)
            .orderBy(F.desc("odds"), "term").limit(size))
    return Lexicon(learned={r["term"]: r["odds"] for r in best.select("term", "odds").collect()})


@dataclass
class Model:
    lexicon: Lexicon
    trees: object | None
    calibration: object | None
    constant: float = 0.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", learn: Column | None = None,
          train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows where ``learn`` (over the label's id) holds."""
    spark = docs.sparkSession
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows if learn is None else rows.where(learn)
    chosen = (rows.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
              .orderBy(F.xxhash64("_id"), "_id", "toxic").limit(train_rows))
    # at most train_rows rows of two numbers: broadcast, so that no text is shuffled
    own = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("text"))
    sample = written(own.join(F.broadcast(chosen), "_id").withColumn(
        "part", F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(5))), "toxicity-sample")
    both = sample.groupBy((F.floor(F.col("part") / 2)).alias("p")).agg(
        F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    total, toxic = sum(r["n"] for r in both), sum(r["t"] for r in both)
    if len(both) < 3 or any(not 0 < r["t"] < r["n"] for r in both):
        return Model(Lexicon(), None, None, toxic / total if total else 0.0)
    lexicon = learn_lexicon(sample.where("part < 2").select("text", "toxic"))
    x = written(sample.where("part >= 2").select(
        "part", F.col("toxic").cast("double").alias("label"),
        feature_column(lexicon, F.col("text"), spark).alias("x")), "toxicity-features")
    vectors = x.select("part", "label", array_to_vector("x").alias("features"))
    trees = GBTClassifier(maxDepth=4, maxIter=20, stepSize=0.2, seed=7, checkpointInterval=-1,
                          minInstancesPerNode=5).fit(vectors.where("part < 4").coalesce(2))
    raw = _probability(trees, vectors.where("part >= 4"), "label")
    calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(raw)
    return Model(lexicon, trees, calibration)


def _probability(trees, rows: DataFrame, *keep: str) -> DataFrame:
    return trees.transform(rows).select(
        *keep, vector_to_array("probability").getItem(1).alias("p"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if model.trees is None:
        scored = own.select("_id", F.lit(float(model.constant)).alias("score"))
    else:
        x = feature_column(model.lexicon, F.col("_text"), docs.sparkSession)
        rows = own.select("_id", array_to_vector(x).alias("features"))
        scored = (model.calibration.transform(_probability(model.trees, rows, "_id"))
                  .select("_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction"))
                          .alias("score")))
    return scored.select(F.col("_id").alias(id_col), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def for_training(id_col: str = "doc_id") -> Column:
    return ~held_out(F.col(id_col), FOLDS, HELD_OUT)
