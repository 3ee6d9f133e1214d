"""Language identification with error-correcting output codes.

Every language has a codeword of bits; one binary classifier per bit is learned from hashed
character n-grams (1 to 3 letters, space as the word edge). A classifier's weight for an
n-gram is the log ratio of its frequency in the languages whose bit is one to those whose bit
is zero, each language counting the same. A text's margin per bit is its mean weight, in units
of that bit's mean training margin. Decoding is loss-weighted: per language the logistic losses
of its codeword's bits, each weighted by the bit's training accuracy above chance; the nearest
codeword wins, and a text is ambiguous where the runner-up is within ``ambiguity``.

The score only compares the learned languages. Whether a text is in one of them at all is
judged on the distance to the winner's codeword: its mean margin a bit, where a training text
has 1 and a text without evidence 0 however many languages there are, must reach ``MIN_MARGIN``,
and the runner-up must not be within ``ambiguity``; both are given the benefit of ``DOUBT`` standard
errors of the text's own mean margin, which is much for a few words and nothing for a long text.
One language alone has one bit, against equally frequent n-grams.

Training reads at most about ``TRAIN_ROWS`` labelled rows a language (all if fewer; chosen by a
hash of id and text, whole texts). What reaches the driver is one number per language and
n-gram bucket (``BUCKETS``) or bit.

Defined results: text null or without a letter is ``und`` with score 0; with one learned
language every text with a letter is that language with score 1; with none, all is ``und``;
rows without a label are not learned from but are predicted; ties go to the first language in
alphabetical order; a text of any length has the n-grams it has in one piece; other columns are
kept by ``accepted`` and ignored elsewhere; repeated rows are predicted each; an empty table gives no rows.
"""
from __future__ import annotations

import itertools
import math
import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import free_name, held_out, whole_text

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
TRAIN_ROWS = 5000
SMOOTHING = 0.5
AMBIGUITY = 0.05
SHARPNESS = 3.0
MIN_SCORE = 0.3
MIN_MARGIN, DOUBT = 0.55, 2.0  # DOUBT: standard errors of a text's mean margin
UNKNOWN = "und"
PIECE = 1 << 20  # code points looked at together: bounds memory for texts of any length
FOLDS, HELD_OUT = 4, 2


@lru_cache(1)
def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or a space."""
    t = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


def buckets(text: str, n_buckets: int = BUCKETS, piece: int | None = None):
    """Arrays of n-gram buckets of a text; all blank ones are left out. Looked at ``piece`` by
    piece: the last letters of a piece lead the next one, and only n-grams that end in new
    letters are counted, so the n-grams are those of the text in one piece."""
    piece = piece or PIECE
    tail = np.array([32], np.uint64)
    for at in range(0, len(text), piece):
        raw = text[at:at + piece].encode("utf-32-le", "replace")
        c = np.concatenate((tail, _fold()[np.frombuffer(raw, np.uint32)],
                            [32] if at + piece >= len(text) else [])).astype(np.uint64)
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
        for n in ORDERS:
            first = max(0, len(tail) - n + 1)
            m = len(c) - n + 1
            if m <= first:
                continue
            h = np.full(m - first, n, np.uint64)
            blank = np.ones(m - first, bool)
            for j in range(n):
                own = c[first + j:j + m]
                h = (h ^ own) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                blank &= own == 32
            yield (h[~blank] % np.uint64(n_buckets)).astype(np.int64)
        tail = c[-(max(ORDERS) - 1):]


def codewords(n: int) -> np.ndarray:
    """One row of +1/-1 per language: the exhaustive code up to seven languages, beyond that
    the best of 64 fixed random codes of 10 log2(n) bits by smallest distance of two rows. One
    language has a single bit, which no other language shares or lacks."""
    if n <= 1:
        return np.ones((n, n), np.int8)
    if n <= 7:
        cols = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(cols, np.int8).T
    bits, best, apart = math.ceil(10 * math.log2(n)), None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, bits))
        same = code.astype(int) @ code.T.astype(int)
        np.fill_diagonal(same, -bits)
        if (d := (bits - same.max()) // 2) > apart and (abs(code.sum(0)) < n).all():
            best, apart = code, d
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # buckets x bits
    scale: np.ndarray     # mean training margin of each bit
    trust: np.ndarray     # training accuracy above chance of each bit

    def read(self, text: str) -> tuple[np.ndarray, int]:
        """Summed weights per bit, and the number of n-grams."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for b in buckets(text, len(self.weights)):
            total += self.weights[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return total, n

    def spread(self, text: str, u: np.ndarray) -> float:
        """Sum of the squares of the n-grams' weights, taken along ``u``."""
        w = self.weights @ u
        return float(sum((w[b] ** 2).sum() for b in buckets(text, len(self.weights))))

    def margins(self, text: str) -> np.ndarray | None:
        total, n = self.read(text)
        return total / n if n else None

    def predict(self, text: str | None, ambiguity: float = AMBIGUITY) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        return self.judge(text, ambiguity)[:3]

    def judge(self, text: str | None,
              ambiguity: float = AMBIGUITY) -> tuple[str, float, bool, bool]:
        """(language, score, ambiguous, known): known if the text is in the language."""
        if not self.langs or not text:
            return UNKNOWN, 0.0, False, False
        total, n = self.read(text)
        if not n:
            return UNKNOWN, 0.0, False, False
        z = self.code * (total / n / self.scale)
        margin = z @ self.trust / self.trust.sum()
        one = len(self.langs) == 1
        loss = (np.logaddexp(0, -SHARPNESS * z) * self.trust).sum(axis=1)
        best = int(loss.argmin())
        gap = np.inf if one else (np.partition(loss, 1)[1] - loss[best]) / (SHARPNESS * max(self.trust.sum(), 1e-9))
        p = np.exp(loss.min() - loss)
        score = 1.0 if one else float(p[best] / p.sum())
        known = margin[best] >= MIN_MARGIN and gap >= ambiguity
        if not known:  # beyond what chance does to a mean of so few n-grams?
            u = self.code[best] * self.trust / self.scale / self.trust.sum()
            doubt = DOUBT * math.sqrt(max(self.spread(text, u) / n - margin[best] ** 2, 0) / n)
            known = margin[best] + doubt >= MIN_MARGIN and gap + doubt >= ambiguity
        return self.langs[best], score, bool(gap < ambiguity), bool(known)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          learn: Column | None = None, train_rows: int = TRAIN_ROWS,
          n_buckets: int = BUCKETS) -> Model:
    """Learn from rows where ``learn`` holds (default: all) and the label is not null."""
    spark = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows if learn is None else rows.where(learn)
    count = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    langs = sorted(count)
    code = codewords(len(langs))
    if not langs:
        return Model([], code, np.zeros((n_buckets, 0), np.float32), np.ones(0), np.ones(0))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col), F.lit(1 << 20))
    share = F.create_map(*itertools.chain(*(
        (F.lit(k), F.lit(math.ceil(train_rows / n * (1 << 20)))) for k, n in count.items())))
    chosen = rows.where(draw < share[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def counted(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = sums.setdefault(lang, np.zeros(n_buckets, np.int64))
                for b in buckets(text.as_py(), n_buckets):
                    s += np.bincount(b, minlength=n_buckets)
        for lang, s in sums.items():
            hit = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(hit)), pa.array(hit, pa.int64()), pa.array(s[hit], pa.int64())],
                names=["lang", "b", "n"])
    counts = np.zeros((len(langs), n_buckets))
    at = {k: i for i, k in enumerate(langs)}
    for r in (chosen.mapInArrow(counted, "lang string, b long, n long")
              .groupBy("lang", "b").agg(F.sum("n").alias("n")).collect()):
        counts[at[r[0]], r[1]] = r[2]
    freq = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * n_buckets)
    # per bit, the mean frequency over the languages whose bit is one, and over the others
    # (where there are none, the same for every n-gram)
    on, off = (code > 0).astype(float), (code < 0).astype(float)
    one = freq.T @ (on / np.maximum(on.sum(0), 1))
    zero = np.where(off.any(0), freq.T @ (off / np.maximum(off.sum(0), 1)), 1 / n_buckets)
    weights = np.log(one / zero).astype(np.float32)
    bits = code.shape[1]
    model = Model(langs, code, weights, np.ones(bits), np.ones(bits))
    if not bits:
        return model
    shared = spark.sparkContext.broadcast(model)

    def margins(batches):
        m = shared.value
        n, total, right = 0, np.zeros(bits), np.zeros(bits)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = m.margins(text.as_py())
                if f is not None:
                    z = f * m.code[m.langs.index(lang)]
                    n, total, right = n + 1, total + z, right + (z > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(bits), pa.int64()), pa.array([n] * bits, pa.int64()),
             pa.array(total), pa.array(right)], names=["j", "n", "z", "r"])
    for j, n, z, r in (chosen.mapInArrow(margins, "j long, n long, z double, r double")
                       .groupBy("j").agg(F.sum("n"), F.sum("z"), F.sum("r")).collect()):
        model.scale[j] = max(z / max(n, 1), 1e-6)
        model.trust[j] = max(2 * r / max(n, 1) - 1, 1e-3)
    return model


def predicted(model: Model, text: Column, spark, ambiguity: float = AMBIGUITY) -> Column:
    """struct<lang_pred string, score double, ambiguous boolean, known boolean> of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, ambiguous: boolean, known: boolean>")
    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        found = [m.judge(t.as_py(), ambiguity) for t in texts]
        lang, score, near, known = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.bool_()),
             pa.array(known, pa.bool_())],
            names=["lang_pred", "score", "ambiguous", "known"])
    return run(whole_text(text))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            ambiguity: float = AMBIGUITY) -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every whole text."""
    p = predicted(model, F.col(text_col), docs.sparkSession, ambiguity)
    return docs.select(F.col(id_col), p.alias("_p")).select(
        id_col, "_p.lang_pred", "_p.score", "_p.ambiguous")


def accepted(docs: DataFrame, model: Model, text_col: str = "text",
             min_score: float = MIN_SCORE) -> DataFrame:
    """The rows in a learned language with at least ``min_score``, with their columns."""
    p = predicted(model, docs[text_col], docs.sparkSession)
    name = free_name(docs, "_language")
    kept = docs.select(*[docs[c] for c in docs.columns], p.alias(name))
    return kept.where(F.col(name)["known"] & (F.col(name)["score"] >= min_score)).drop(name)


def for_training(id_col: str = "doc_id") -> Column:
    return ~held_out(F.col(id_col), FOLDS, HELD_OUT)
