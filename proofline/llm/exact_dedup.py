"""Exact de-duplication by skew-safe combining, in DataFrame operations only.

Equal texts are combined in three steps, each comparing the full content, not only the
digest: (1) within a task, before anything is shuffled; (2) per salt, so that a text that
a third of all rows share arrives at ``salts`` tasks, one row per map task; (3) the salt
winners, at most ``salts`` rows per text. Rows then learn their winner by a join on the
digest that carries no text, salted for groups of two or more rows.

Defined results: a null text counts as empty; an id may be null (it never wins against a
number; a group of null ids alone keeps a null id); of rows that repeat both id and text,
one is kept; an empty table gives no rows; columns other than id and text do not matter.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import whole_text, written

SALTS = 16


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _tagged(docs: DataFrame, text_col: str, salts: int, digest, extra: list[Column]) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(digest(text).alias("_digest"), text.alias("_text"),
                       (F.spark_partition_id() % salts).alias("_salt"), *extra)


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            salts: int = SALTS, digest=sha256_hex) -> DataFrame:
    """One row per distinct text: _digest, _text, keep_id (largest id), group_size."""
    t = _tagged(docs, text_col, salts, digest, [F.col(id_col).alias("_id")])
    salted = t.groupBy("_digest", "_text", "_salt").agg(
        F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_digest", "_text").agg(
        F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 salts: int = SALTS, digest=sha256_hex) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    won = written(winners(docs, id_col, text_col, salts, digest).select(
        "_digest", "keep_id", "group_size", sha256_hex(F.col("_text")).alias("text_sha256")),
        "exact-winners")
    # The join on the digest is exact unless two contents share one; then it compares texts.
    clash = won.groupBy("_digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if clash.limit(1).count():
        return _by_content(docs, id_col, text_col, salts, digest)
    key = digest(whole_text(text_col))
    rows = (docs.select(F.col(id_col).alias("_id"), key.alias("_digest"))
            .groupBy("_id", "_digest").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")))
    spread = won.select(
        "_digest", "keep_id", "group_size", "text_sha256",
        F.explode(F.when(F.col("group_size") > 1, F.sequence(F.lit(0), F.lit(salts - 1)))
                  .otherwise(F.array(F.pmod(F.xxhash64("keep_id"), F.lit(salts)).cast("int")))
                  ).alias("_s"))
    return _per_row(rows.join(spread, ["_digest", "_s"]), id_col)


def _by_content(docs, id_col, text_col, salts, digest) -> DataFrame:
    """The same result when two contents share a digest: the join compares the texts."""
    won = winners(docs, id_col, text_col, salts, digest)
    text = whole_text(text_col)
    rows = (docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
            .groupBy("_id", "_text").agg(F.count(F.lit(1)).alias("_n")))
    return _per_row(rows.join(won, "_text").withColumn("text_sha256", sha256_hex(F.col("_text"))),
                    id_col)


def _per_row(joined: DataFrame, id_col: str) -> DataFrame:
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))
    return joined.withColumn("_i", copies).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"),
        "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                salts: int = SALTS, digest=sha256_hex) -> DataFrame:
    """The rows that stay, with the columns they came with: of equal texts the one with the
    largest id (then the largest remaining columns). The winning row travels through the
    same three steps, so no second join over the texts is needed. A null text that wins
    stays null, whatever its copies are. Columns other than the text must be orderable."""
    names = docs.columns
    rest = [c for c in names if c not in (id_col, text_col)]
    row = F.struct(F.col(id_col).alias("_id"), F.col(text_col).isNull().alias("_null"),
                   *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)])
    t = _tagged(docs, text_col, salts, digest, [row.alias("_row")])
    best = (t.groupBy("_digest", "_text", "_salt").agg(F.max("_row").alias("_row"))
            .groupBy("_digest", "_text").agg(F.max("_row").alias("_row")))
    out = {id_col: F.col("_row._id"),
           text_col: F.when(~F.col("_row._null"), F.col("_text"))}
    out |= {c: F.col(f"_row._c{i}") for i, c in enumerate(rest)}
    return best.select(*[out[c].alias(c) for c in names])
