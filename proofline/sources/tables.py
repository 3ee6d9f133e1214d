"""Parquet scans of the driver's test tables and the entity views derived from them.

Each derivation exists twice, side by side: as a DataFrame (used by the queries) and as
the SQL text of the same expression (used by the oracle). The derivations are row-wise
projections or key joins, so they keep the scans' column pruning and filter pushdown.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- responses with a text body: documents ---------------------------------------
# run = lang, suite = source, case = doc_id; requirement_ref = 'R' || (doc_id % 9 + 1),
# NULL when doc_id % 11 = 0.
def text_responses(spark, sf_dir, extra: list[str] = ()) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("lang").alias("run_id"), F.col("source").alias("suite_id"),
        F.col("doc_id").alias("case_id"), "text",
        F.when(F.col("doc_id") % 11 != 0,
               F.concat(F.lit("R"), (F.col("doc_id") % 9 + 1).cast("string")))
        .alias("requirement_ref"), *extra)


SQL_TEXT_RESPONSES = """(SELECT lang AS run_id, source AS suite_id, doc_id AS case_id, text,
  CASE WHEN doc_id % 11 <> 0 THEN 'R' || CAST(doc_id % 9 + 1 AS VARCHAR) END AS requirement_ref
  FROM documents)"""


# ---- responses with a JSON body: events ------------------------------------------
# run = user_id, suite = event_type, case = event_id, body = props, latency = value.
def json_responses(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("suite_id"),
                    F.col("event_id").alias("case_id"), F.col("props").alias("body"),
                    F.col("value").alias("latency_ms"), F.col("ts").alias("captured_at"))


SQL_JSON_RESPONSES = """(SELECT user_id AS run_id, event_type AS suite_id, event_id AS case_id,
  props AS body, value AS latency_ms, ts AS captured_at FROM events)"""


# ---- nested JSON bodies: one per lineitem row -------------------------------------
# findings = [ {status from l_returnflag, severity from l_quantity, article from l_partkey
#               ('' when l_discount < 0.02)},
#              {status from l_linestatus, severity from l_tax, article NULL when
#               l_linenumber is odd} ]
# The body is built from the row alone (no grouping), so it scales with the table.
def _status(c):
    return (F.when(c == "A", "shippable").when(c == "N", "mitigate").when(c == "R", "blocked")
            .when(c == "O", "mitigate").otherwise("shippable"))


def finding_responses(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity", "l_tax",
        "l_discount", "l_partkey", "l_suppkey")
    sev1 = (F.when(F.col("l_quantity") < 13, "low").when(F.col("l_quantity") < 26, "medium")
            .when(F.col("l_quantity") < 38, "high").otherwise("critical"))
    sev2 = (F.when(F.col("l_tax") < 0.02, "low").when(F.col("l_tax") < 0.04, "medium")
            .when(F.col("l_tax") < 0.06, "high").when(F.col("l_tax") < 0.08, "critical")
            .otherwise("urgent"))
    art1 = F.when(F.col("l_discount") < 0.02, F.lit("")).otherwise(
        F.concat(F.lit("Art. "), (F.col("l_partkey") % 97).cast("string")))
    art2 = F.when(F.col("l_linenumber") % 2 == 1, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("Art. "), (F.col("l_suppkey") % 89).cast("string")))
    f1 = F.struct(_status(F.col("l_returnflag")).alias("status"), sev1.alias("severity"),
                  art1.alias("article"))
    f2 = F.struct(_status(F.col("l_linestatus")).alias("status"), sev2.alias("severity"),
                  art2.alias("article"))
    body = F.to_json(F.struct(F.array(f1, f2).alias("findings")), {"ignoreNullFields": "false"})
    return li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linestatus").alias("suite_id"),
                     "l_orderkey", "l_linenumber", body.alias("body"))


def _sql_status(c):
    return (f"CASE {c} WHEN 'A' THEN 'shippable' WHEN 'N' THEN 'mitigate' WHEN 'R' THEN 'blocked' "
            f"WHEN 'O' THEN 'mitigate' ELSE 'shippable' END")


SQL_FINDINGS = f"""(SELECT l_orderkey, l_linenumber, l_linestatus,
  {_sql_status('l_returnflag')} AS s1,
  CASE WHEN l_quantity < 13 THEN 'low' WHEN l_quantity < 26 THEN 'medium'
       WHEN l_quantity < 38 THEN 'high' ELSE 'critical' END AS v1,
  CASE WHEN l_discount < 0.02 THEN '' ELSE 'Art. ' || CAST(l_partkey % 97 AS VARCHAR) END AS a1,
  {_sql_status('l_linestatus')} AS s2,
  CASE WHEN l_tax < 0.02 THEN 'low' WHEN l_tax < 0.04 THEN 'medium' WHEN l_tax < 0.06 THEN 'high'
       WHEN l_tax < 0.08 THEN 'critical' ELSE 'urgent' END AS v2,
  CASE WHEN l_linenumber % 2 = 1 THEN NULL ELSE 'Art. ' || CAST(l_suppkey % 89 AS VARCHAR) END AS a2
  FROM lineitem)"""


# ---- case results: lineitem rows ---------------------------------------------------
# run = l_orderkey, suite = l_linestatus, requirement_ref = 'R' || (l_suppkey % 12 + 1),
# passed = l_returnflag <> 'R'; human verdict pass if l_discount > 0.08, fail if
# l_tax > 0.07, else none; cost = l_extendedprice / 1e6.
def case_results(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    human = (F.when(F.col("l_discount") > 0.08, F.lit("pass"))
             .when(F.col("l_tax") > 0.07, F.lit("fail")))
    return li.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linestatus").alias("suite_id"),
        "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.lit("R"), (F.col("l_suppkey") % 12 + 1).cast("string")).alias("requirement_ref"),
        (F.col("l_returnflag") != "R").alias("passed"),
        human.alias("human_verdict"),
        (F.col("l_extendedprice") / 1e6).alias("cost_usd"),
        F.col("l_shipdate").alias("finished_at"))


SQL_CASE_RESULTS = """(SELECT l_orderkey AS run_id, l_linestatus AS suite_id, l_linenumber,
  l_partkey, l_suppkey,
  'R' || CAST(l_suppkey % 12 + 1 AS VARCHAR) AS requirement_ref,
  l_returnflag <> 'R' AS passed,
  CASE WHEN l_discount > 0.08 THEN 'pass' WHEN l_tax > 0.07 THEN 'fail' END AS human_verdict,
  l_extendedprice / 1e6 AS cost_usd, l_shipdate AS finished_at
  FROM lineitem)"""


# ---- runs and reports: orders joined to their customer -----------------------------
# report = run = o_orderkey; project = c_mktsegment; state F/O/P = done /
# ready_for_review / pending; verdict pass if done and o_totalprice > 250000, fail if
# done otherwise; created_at = o_orderdate; reviewer = 'rev' || (o_custkey % 7).
def reports(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    state = (F.when(F.col("o_orderstatus") == "F", "done")
             .when(F.col("o_orderstatus") == "O", "ready_for_review").otherwise("pending"))
    verdict = F.when(F.col("o_orderstatus") == "F",
                     F.when(F.col("o_totalprice") > 250000, "pass").otherwise("fail"))
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_orderkey").alias("run_id"),
        F.col("c_mktsegment").alias("project"), state.alias("state"),
        verdict.alias("verdict"), F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("total_price"), "o_custkey",
        F.concat(F.lit("rev"), (F.col("o_custkey") % 7).cast("string")).alias("reviewer"),
        F.col("o_orderpriority").alias("priority"))


SQL_REPORTS = """(SELECT o_orderkey AS report_id, o_orderkey AS run_id, c_mktsegment AS project,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'ready_for_review' ELSE 'pending' END AS state,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 250000 THEN 'pass' ELSE 'fail' END END AS verdict,
  o_orderdate AS created_at, o_totalprice AS total_price, o_custkey,
  'rev' || CAST(o_custkey % 7 AS VARCHAR) AS reviewer, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# ---- requirement list: R1..R15 without R2 ------------------------------------------
# A literal of 14 rows (size fixed, so it may always be broadcast).
REQUIREMENT_IDS = [f"R{i}" for i in range(1, 16) if i != 2]


def requirements(spark) -> DataFrame:
    rows = [(r, f"Requirement {r[1:]} holds.", "Core" if int(r[1:]) <= 8 else "Extended")
            for r in REQUIREMENT_IDS]
    return spark.createDataFrame(rows, "req_id string, text string, section string")


SQL_REQUIREMENTS = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', 'Requirement {r[1:]} holds.', '{'Core' if int(r[1:]) <= 8 else 'Extended'}')"
    for r in REQUIREMENT_IDS) + ") AS t(req_id, text, section))"
