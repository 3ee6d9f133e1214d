"""Line de-duplication with a suffix array over line ids, in DataFrame operations only.

Every non-blank line gets an id, the rank of its digest; a document is the sequence of its
ids. Distributed prefix doubling sorts the suffixes to depth 1, 2, 4, ... lines: the rank of a
suffix at twice the depth is the rank of the pair (its rank, the rank of the suffix that many
lines on), ranked by a range-partitioned sort of the distinct pairs. Suffixes of equal rank at
a depth are an interval of the suffix array whose longest common prefix is at least that depth,
so the intervals at depth ``min_lines`` hold exactly the repeated runs of ``min_lines`` lines or
more: a longer run is a chain of them. Suffixes alone in their interval leave after each round.

In every interval the first suffix, by document id and place, stays; lines that a later one
covers are deleted. A single line of ``min_words`` words or more is a run of its own.

A line or run may hold a third of all rows: intervals are counted by partial aggregates and
met again under several salts; no interval is gathered in a task.

Defined results: null and empty texts have no lines and stay as they are; blank lines
are kept and do not part a run; a document's last lines have no suffix deeper than
themselves; a run that overlaps itself within a document keeps its first copy's lines except
those that its second copy covers; rows that repeat both id and text are one document; rows
that repeat an id alone are ordered by a hash of their text; a null id comes first; an empty
table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import whole_text, written

MIN_LINES = 2
MIN_WORDS = 50
SALTS = 16
KEY = ["_id", "_h", "_pos"]


def _meet(a: DataFrame, b: DataFrame, shift: int, how: str) -> DataFrame:
    """Join on the place, ``shift`` lines further on in ``b``; a null id meets a null id."""
    b = b.withColumnsRenamed({"_id": "b_id", "_h": "b_h", "_pos": "b_pos"})
    on = (F.col("_id").eqNullSafe(F.col("b_id")) & (F.col("_h") == F.col("b_h"))
          & (F.col("_pos") + shift == F.col("b_pos")))
    return a.join(b, on, how)


def _ranked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """_id, _h, _pos, rank, first for the rows whose ``by`` occurs twice or more: equal ``by``,
    equal rank; ranks rise with ``by``; first is the earliest place of that rank."""
    place = F.struct(*KEY)
    groups = (rows.groupBy(*by).agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first"))
              .where("c > 1"))
    # increasing ids over a range-partitioned sort are ranks; written, so they are fixed
    ranks = written(groups.repartitionByRange(*by).sortWithinPartitions(*by).select(
        *by, F.monotonically_increasing_id().alias("rank"), "first"), f"{name}-ranks")
    spread = ranks.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)).cast("int"))
    return written(salted.join(spread, [*by, "_s"]).select(*rows.columns, "rank", "first"), name)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _h, _line (number in the text), _pos (number among non-blank lines), _digest, _words."""
    own = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    split = F.transform(F.split("_text", "\n"), lambda x, i: F.struct(
        i.alias("line"), F.unhex(F.md5(x)).alias("digest"),
        (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words"),
        x.rlike(r"[^ \t\r]").alias("full")))
    full = F.filter(split, lambda x: x["full"])
    # rows that repeat both id and text are one document
    rows = own.select("_id", F.xxhash64("_text").alias("_h"), full.alias("_l"))
    return rows.select("_id", "_h", F.posexplode("_l").alias("_pos", "_x")).select(
        "_id", "_h", "_pos", F.col("_x.line").alias("_line"), F.col("_x.digest").alias("_digest"),
        F.col("_x.words").alias("_words")).groupBy("_id", "_h", "_pos").agg(
        F.first("_line").alias("_line"), F.first("_digest").alias("_digest"),
        F.first("_words").alias("_words"))


def later_copies(lines: DataFrame, min_lines: int = MIN_LINES,
                 min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _h, _line, _pos) of every line that a later copy of a repeated run covers."""
    if min_lines < 1:
        raise ValueError("min_lines is 1 or more")
    base = _ranked(lines, ["_digest"], "lines").select(*KEY, "_line", "_words", "rank", "first")
    late = F.col("first") < F.struct(*KEY)
    single = base.where(late & (F.col("_words") >= min_words)).select("_id", "_h", "_pos")
    level, depth = base.select(*KEY, "rank", "first"), 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)  # the last step overlaps to end at min_lines
        ahead = level.select(*KEY, F.col("rank").alias("r2"))
        own = level.select(*KEY, F.col("rank").alias("r1"))
        pairs = _meet(own, ahead, step, "inner").select(*KEY, "r1", "r2")
        level, depth = _ranked(pairs, ["r1", "r2"], f"runs-{depth + step}").select(
            *KEY, "rank", "first"), depth + step
    runs = level.where(late).select("_id", "_h", F.explode(F.sequence(
        F.col("_pos"), F.col("_pos") + (min_lines - 1))).alias("_pos"))
    hit = runs.union(single).distinct()
    return _meet(base, hit, 0, "left_semi").select("_id", "_h", "_line", "_pos")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: id, text without later copies, n_lines (non-blank), n_deleted,
    runs (array of deleted maximal runs: first line number and number of lines)."""
    gone = later_copies(written(lines_of(docs, id_col, text_col), "lines-all"),
                        min_lines, min_words)
    # islands of consecutive lines, within one document
    island = F.col("_line") - F.row_number().over(Window.partitionBy("_id", "_h").orderBy("_line"))
    spans = gone.withColumn("_g", island).groupBy("_id", "_h", "_g").agg(
        F.min("_line").alias("start"), F.count(F.lit(1)).cast("int").alias("n"))
    spans = spans.groupBy(F.col("_id").alias("_i"), F.col("_h").alias("_g")).agg(
        F.array_sort(F.collect_list(F.struct("start", "n"))).alias("runs"))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"),
                      F.xxhash64(whole_text(text_col)).alias("_h"))
    both = own.join(spans, own["_id"].eqNullSafe(spans["_i"]) & (own["_h"] == spans["_g"]), "left")
    lines = F.split("_t", "\n")
    return both.select(
        F.col("_id").alias(id_col),
        F.when(F.col("runs").isNull(), F.col("_t")).otherwise(_without(lines, F.col("runs")))
        .alias(text_col),
        F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(r"[^ \t\r]"))), F.lit(0)).alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0), lambda a, r: a + r["n"]), F.lit(0)).alias("n_deleted"),
        F.coalesce("runs", F.array().cast("array<struct<start:int,n:int>>")).alias("runs"))


def _without(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, joined: one slice between each run and the next."""
    edge = F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"))
    bounds = F.concat(F.array(edge), runs, F.array(F.struct(F.size(lines).alias("start"),
                                                            F.lit(0).alias("n"))))
    kept = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.slice(
        lines, F.element_at(bounds, i)["start"] + F.element_at(bounds, i)["n"] + 1,
        F.element_at(bounds, i + 1)["start"] - F.element_at(bounds, i)["start"]
        - F.element_at(bounds, i)["n"]))
    return F.array_join(F.flatten(kept), "\n")
