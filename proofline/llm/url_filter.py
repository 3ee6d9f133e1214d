"""URL filters by a temporal list join, in DataFrame operations only.

List entries are dated: at an instant a value (a domain, or a host with a path prefix) is
added to a category or removed from it. They become disjoint validity intervals, and every
capture is judged against the entries in force when it was fetched: an as-of join on the
lookup keys of its URL (each domain suffix of the host, each path prefix) with
``valid_from <= fetched_at < valid_to``.

A host or domain may hold a third of all captures: keys are salted on the capture side and the
intervals, a list far smaller than the captures, are repeated once a salt. A value that is
added and removed very often is cut by month when its next change is looked up.

Defined results: a null or unparsable URL, or a null fetch time, matches nothing; add and
remove at one instant count as add; entries with a null value, instant or an action other than
add/remove are ignored, a null category is its own category; hosts, also that of a prefix
entry, are compared in lower case, those of URLs without port, user part and final dot; paths
are compared as written; repeated captures are each returned; an empty list
blocks nothing; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.lower(F.regexp_replace(raw, r"\.$", ""))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1)


def lookup_keys(host: Column, path: Column) -> Column:
    """array<struct<kind, value>>: domain suffixes of two labels or more (the whole host always,
    a numeric host only itself), and host plus each prefix of whole path segments."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    numeric = host.rlike(r"^[0-9.]+$") | (n == 1)
    suffixes = F.when(numeric, F.array(host)).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, n), ".")))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
        lambda i: F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i), "/")))).otherwise(
        F.array().cast("array<string>"))
    return F.concat(
        F.transform(suffixes, lambda v: F.struct(F.lit("domain").alias("kind"), v.alias("value"))),
        F.transform(prefixes, lambda v: F.struct(F.lit("prefix").alias("kind"), v.alias("value"))))


def entry_value(kind: Column, value: Column) -> Column:
    """A listed value with its host in lower case; the path of a prefix stays as listed."""
    host = F.substring_index(value, "/", 1)
    return F.when(kind == "prefix", F.concat(F.lower(host), F.substr(value, F.length(host) + 1))
                  ).otherwise(F.lower(value))


def validity(entries: DataFrame) -> DataFrame:
    """(kind, value, category, valid_from, valid_to) from (kind, value, category, action, at):
    disjoint per kind, value and category; an open interval has a null valid_to."""
    key = ["kind", "value", "category"]
    state = (entries.where("value is not null and at is not null and action in ('add', 'remove')")
             .groupBy("kind", entry_value(F.col("kind"), F.col("value")).alias("value"), "category", "at")
             .agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
             .withColumn("month", F.trunc(F.col("at"), "month")))
    first = state.groupBy(*key, "month").agg(F.min("at").alias("first"))
    later = first.select(*key, "month", F.lead("first").over(
        Window.partitionBy(*key).orderBy("month")).alias("later"))
    here = state.withColumn("next", F.lead("at").over(
        Window.partitionBy(*key, "month").orderBy("at")))
    same = [here[c].eqNullSafe(later[c]) for c in (*key, "month")]
    return here.where("on = 1").join(later, same, "left").select(
        *[here[c] for c in key], here["at"].alias("valid_from"),
        F.coalesce(here["next"], later["later"]).alias("valid_to"))


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
           at_col: str = "fetched_at", salts: int = SALTS) -> DataFrame:
    """One row per capture: id, host, fetched_at, blocked, n_matches (entries in force that
    match), categories (sorted), listed_since (earliest start among them)."""
    rows = (captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"),
                            F.col(at_col).alias("_at"))
            .groupBy("_id", "_url", "_at").agg(F.count(F.lit(1)).alias("_copies")))
    host = host_of(F.col("_url"))
    keyed = rows.withColumn("_host", host).select(
        "_id", "_url", "_at", "_copies", "_host",
        F.explode_outer(lookup_keys(F.col("_host"), path_of(F.col("_url")))).alias("_k"),
        F.pmod(F.xxhash64("_id", "_url", "_at"), F.lit(salts)).cast("int").alias("_s"))
    listed = validity(entries).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    match = keyed.join(
        listed, (keyed["_k.kind"] == listed["kind"]) & (keyed["_k.value"] == listed["value"])
        & (keyed["_s"] == listed["_salt"]) & (keyed["_at"] >= listed["valid_from"])
        & (listed["valid_to"].isNull() | (keyed["_at"] < listed["valid_to"])), "left")
    hit = F.col("valid_from").isNotNull()
    out = match.groupBy("_id", "_url", "_at", "_host", "_copies").agg(
        F.count("valid_from").alias("n_matches"),
        F.collect_set(F.when(hit, F.coalesce("category", F.lit("")))).alias("_c"),
        F.min("valid_from").alias("listed_since"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return out.withColumn("_copy", copy).select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_at").alias(at_col),
        (F.col("n_matches") > 0).alias("blocked"), "n_matches",
        F.array_join(F.array_sort("_c"), ",").alias("categories"), "listed_since")
