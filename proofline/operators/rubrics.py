"""Rubrics as rows: lint of written rubrics, the fallback rubric (TXT-9, TXT-10)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions import jsonpath as jp
from proofline.operators.specs import as_object, scalar_text
from proofline.operators.testsets import py_strip

# ---- fixed values that must equal the reference's --------------------------------
DIMENSION_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{1,47}$"
LEVELS = ["0", "1", "2"]
MIN_LEVEL_CHARS = 12
MIN_QUESTION_CHARS = 10
# Words that grade rather than describe: a level made only of these is no anchor.
VACUOUS = [
    "good", "bad", "ok", "okay", "fine", "poor", "great", "excellent", "yes",
    "no", "pass", "fail", "passing", "failing", "partial", "partially", "meets",
    "met", "unmet", "none", "acceptable", "unacceptable", "correct", "incorrect",
    "not", "very", "somewhat", "mostly", "fully", "overall", "quite", "the", "a",
    "an", "is", "are", "response", "answer", "output", "at", "all", "level",
]
FALLBACK_DIMENSIONS = [
    ("requirement_met", "Does the response satisfy: {}?", 2, [
        "the response contradicts the assertion or does not address it",
        "the response addresses the assertion but leaves part of it unmet or ambiguous",
        "the response fully satisfies the assertion, with nothing missing or contradicted"]),
    ("grounded_in_input", "Is every factual claim in the response traceable to the case input or to "
     "the response's own cited sources?", 1, [
         "the response states facts that appear in neither the input nor any source it cites",
         "most claims are traceable, but at least one is unsupported or cites nothing",
         "every claim is traceable to the input or to a source the response names"]),
]
# -----------------------------------------------------------------------------------


def _level_bad(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    vacuous = F.array(*[F.lit(w) for w in VACUOUS])
    return (F.length(text) < MIN_LEVEL_CHARS) | F.forall(words, lambda w: F.array_contains(vacuous, w))


def _whole(v: Column) -> Column:
    """The integer a VARIANT score level means, NULL if none."""
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double").try_cast("int")
    return F.when(F.schema_of_variant(v) == "STRING", text.try_cast("int")).otherwise(number)


def lint_dimensions(rubrics: DataFrame, key: str, rubric: str = "rubric") -> DataFrame:
    """(key, pos, dim, min_score, reason): one row per dimension of every written rubric, the
    first rule that it breaks, NULL if none; a rubric that is no object or has fewer than two
    dimensions is one row with pos NULL."""
    m = as_object(jp.strict_json(F.col(rubric)))
    dims = F.element_at(F.col("_m"), "dimensions").try_cast("array<variant>")
    r = rubrics.withColumn("_m", m).select(key, F.col("_m").isNull().alias("_none"), dims.alias("_d"),
                                           F.element_at(F.col("_m"), "min_score").alias("_min"))
    short = F.col("_none") | F.coalesce(F.size("_d") < 2, F.lit(True))
    whole = r.where(short).select(
        key, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("dim"),
        F.lit(None).cast("int").alias("min_score"),
        F.when(F.col("_none"), "not an object").otherwise("needs at least 2 dimensions").alias("reason"))
    d = r.where(~short).select(key, "_min", F.posexplode("_d").alias("pos", "v")).withColumn(
        "o", as_object(F.col("v")))
    scale = as_object(F.element_at("o", "scale"))
    own = F.element_at("o", "min_score")
    d = d.select(
        key, "pos", F.col("o").isNull().alias("none"), py_strip(scalar_text(F.element_at("o", "id"))).alias("dim"),
        py_strip(scalar_text(F.element_at("o", "question"))).alias("question"),
        F.transform_keys(scale, lambda k, v: F.trim(k)).alias("scale"),
        F.coalesce(own, "_min").alias("ms"))
    earlier = d.groupBy(key, "dim").agg(F.min("pos").alias("first"))
    d = d.join(earlier, [key, "dim"])
    levels = [py_strip(scalar_text(F.element_at("scale", lv))) for lv in LEVELS]
    missing = F.lit(False)
    bad = F.lit(False)
    for lv, text in zip(LEVELS, levels, strict=True):
        missing = missing | ~F.map_contains_key("scale", F.lit(lv))
        bad = bad | _level_bad(text)
    top = len(LEVELS) - 1
    min_score = F.when(F.col("ms").isNull(), F.lit(top)).otherwise(_whole(F.col("ms")))
    reason = (F.when(F.col("none"), "not an object").when(~F.col("dim").rlike(DIMENSION_ID), "id is not a slug")
              .when(F.col("first") < F.col("pos"), "duplicate id")
              .when(F.length("question") < MIN_QUESTION_CHARS, "no usable question")
              .when(F.col("scale").isNull(), "no scale").when(missing, "missing scale level")
              .when(bad, "level is not an observable anchor")
              .when(min_score.isNull(), "non-numeric min_score")
              .when((min_score < 0) | (min_score > top), "min_score outside the scale"))
    return d.select(key, "pos", "dim", min_score.alias("min_score"), reason.alias("reason")).unionByName(whole)


def lint(rubrics: DataFrame, key: str, rubric: str = "rubric") -> DataFrame:
    """TXT-9 per rubric: usable, and the reason of the first dimension that is not."""
    rows = lint_dimensions(rubrics, key, rubric)
    return rows.groupBy(key).agg(
        F.count("pos").alias("dimensions"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.coalesce("pos", F.lit(-1)))).alias("reason")
    ).select(key, "dimensions", F.col("reason").isNull().alias("usable"), "reason")


def fallback_rubrics(intents: DataFrame, assertion: str = "assertion") -> DataFrame:
    """TXT-10: two anchored dimensions per judge intent, one row each."""
    a = F.coalesce(F.nullif(py_strip(F.col(assertion)), F.lit("")), F.lit("the requirement is met"))
    dims = []
    for pos, (dim, question, min_score, scale) in enumerate(FALLBACK_DIMENSIONS):
        head, _, tail = question.partition("{}")
        text = F.concat(F.lit(head), a, F.lit(tail)) if "{}" in question else F.lit(question)
        dims.append(F.struct(F.lit(pos).alias("pos"), F.lit(dim).alias("dim"), text.alias("question"),
                             F.lit(min_score).alias("min_score"),
                             F.array(*[F.lit(x) for x in scale]).alias("scale")))
    return intents.where("how = 'judge'").select("*", F.inline(F.array(*dims)),
                                                 F.lit(True).alias("require_evidence"), F.lit(1).alias("samples"))
