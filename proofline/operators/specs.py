"""Stored configs and what they are built from: reference resolution, dataset binding, case
validation, spec assembly and flattening, config edits, imports (TXT-3, 6..8, 11, 12; SRC-3,
SRC-5; SCL-3, SCL-9; CHK-24; AGG-17).

Rows carry the key of the group they belong to (a document, a dataset, a version). Collected
arrays hold one group's requirements or one version's config: what a person wrote, one row
of the config table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import jsonpath as jp
from proofline.functions.columns import let
from proofline.functions.text import ID_OK, ID_UNSAFE, slug, strip_chars, tokens
from proofline.operators.numbering import numbered
from proofline.operators.testsets import dedup_ids, py_strip
from proofline.session import checkpoint_dir

# ---- fixed values that must equal the reference's --------------------------------
KINDS = ["nominal", "empty", "boundary", "hostile"]
ROW_META = ["id", "kind", "context"]
# -----------------------------------------------------------------------------------


# ---- JSON values -------------------------------------------------------------------

def as_object(v: Column) -> Column:
    """map<string,variant> of a VARIANT object, NULL for anything else."""
    return v.try_cast("map<string,variant>")


def filled(m: Column) -> Column:
    return F.coalesce(F.size(m) > 0, F.lit(False))


def object_text(m: Column) -> Column:
    """Canonical JSON text of a map<string,variant>: members sorted by key, no blanks."""
    entries = F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(
        F.to_json(F.parse_json(F.concat(F.lit('"'), _json_escaped(k), F.lit('"')))), F.lit(":"),
        F.coalesce(F.to_json(F.element_at(m, k)), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def _json_escaped(s: Column) -> Column:
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, rep in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(rep))
    return out


def scalar_text(v: Column) -> Column:
    """``str(value or "")``: empty for null, false, 0, "" and empty containers."""
    kind = jp.variant_kind(v)
    text = F.try_variant_get(v, "$", "string")
    return (F.when(v.isNull() | (kind == "null"), "")
            .when(kind == "boolean", F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise(""))
            .when(kind == "number", F.when(F.try_variant_get(v, "$", "double") == 0, "").otherwise(F.to_json(v)))
            .when(kind == "string", text)
            .when(F.to_json(v).isin("{}", "[]"), "").otherwise(F.to_json(v)))


def canonical_hash(*parts: Column) -> Column:
    """SCL-3: sha256 of the parts' canonical JSON texts, one per line."""
    return F.sha2(F.concat_ws("\n", *parts), 256)


def visible(m: Column) -> Column:
    """SCL-9: the members whose key does not begin with an underscore."""
    return F.map_filter(m, lambda k, v: ~F.startswith(k, F.lit("_")))


def determinism(check_type: Column) -> Column:
    """CHK-24."""
    return F.when(check_type == "judge", "stochastic").otherwise("deterministic")


# ---- TXT-3 / WIN-10: requirement references -------------------------------------------

def requirement_lists(reqs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, reqs): the requirements of each group in order, with their word sets."""
    return reqs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "position", "req_id", tokens(F.col("text")).alias("words")))).alias("reqs"))


def resolved_ref(raw: Column, assertion: Column, reqs: Column) -> Column:
    """The requirement id that a written reference means, NULL when none fits: the id itself,
    the id in capitals without blanks, its first number, the requirement that shares most words
    with reference and assertion (the earliest of equals), the only requirement there is."""
    written = py_strip(F.coalesce(raw, F.lit("")))
    upper = F.replace(F.upper(written), F.lit(" "), F.lit(""))
    number = F.regexp_replace(F.regexp_extract(upper, r"R?(\d+)", 1), "^0+(?=.)", "")
    given = F.struct(
        F.transform(reqs, lambda r: r["req_id"]).alias("ids"), written.alias("written"), upper.alias("upper"),
        F.when(number != "", F.concat(F.lit("R"), number)).alias("numbered"),
        tokens(F.concat_ws(" ", written, F.coalesce(assertion, F.lit("")))).alias("wanted"))

    def cascade(g: Column) -> Column:
        # the largest overlap, then the smallest position
        best = F.array_max(F.transform(reqs, lambda r: F.struct(
            F.size(F.array_intersect(g["wanted"], r["words"])).alias("n"), (-r["position"]).alias("p"),
            r["req_id"].alias("id"))))

        def known(c: Column) -> Column:
            return F.when(F.array_contains(g["ids"], c), c)
        return F.coalesce(known(g["written"]), known(g["upper"]), known(g["numbered"]),
                          F.when(best["n"] > 0, best["id"]), F.when(F.size(g["ids"]) == 1, F.get(g["ids"], F.lit(0))))
    return let(given, cascade)


def resolve_refs(intents: DataFrame, reqs: DataFrame, key: str = "doc_id", ref: str = "requirement_ref",
                 assertion: str = "assertion") -> DataFrame:
    """Intents with ``resolved_ref`` and, where nothing fits, a reject reason."""
    j = intents.join(requirement_lists(reqs, key), key, "left")
    lists = F.coalesce("reqs", F.expr("cast(array() as array<struct<position:int,req_id:string,words:array<string>>>)"))
    out = j.withColumn("resolved_ref", resolved_ref(F.col(ref), F.col(assertion), lists))
    return out.withColumn("ref_reject", F.when(F.col("resolved_ref").isNull(), F.concat(
        F.lit("unknown requirement "), F.coalesce(F.col(ref), F.lit("None"))))).drop("reqs")


# ---- SRC-3: JSONL datasets -------------------------------------------------------------

def jsonl_rows(spark, path: str, through: bool = False) -> DataFrame:
    """(file, line, value) of every line; line numbers count blank lines. Splits of one file are
    numbered apart and put together by one small table of split sizes. With ``through`` the
    numbers run on from file to file, in the order of their names."""
    t = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sizes = t.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # one row per split, whatever it holds
    order = Window.orderBy("file", "block") if through else Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.join(sizes.withColumn("before", before).drop("n"), ["file", "block"]).select(
        "file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def parsed_rows(rows: DataFrame) -> DataFrame:
    """(file, line, value, reason): blank lines go; ``reason`` says why a line is quarantined,
    NULL for a JSON object."""
    v = jp.strict_json(F.col("value"))
    kind = jp.variant_kind(F.col("_v"))
    reason = (F.when(F.col("_v").isNull(), "not valid JSON")
              .when(kind != "object", F.concat(F.lit("expected a JSON object, got "), kind)))
    return (rows.where(F.trim("value") != "").withColumn("_v", v)
            .withColumn("reason", F.when(reason.isNotNull(), F.concat_ws(
                "", F.element_at(F.split("file", "/"), -1), F.lit(":"), F.col("line").cast("string"),
                F.lit(": "), reason))).drop("_v"))


# ---- TXT-6: dataset rows -> cases ------------------------------------------------------

def dataset_cases(rows: DataFrame, key: str, index: str, row: str = "value") -> DataFrame:
    """(key, index, case_id, kind, input, context, reason) per dataset row: the row's ``input``
    object, else the row without its id, kind and context. Ids are made safe and unique within
    the dataset; ``reason`` names a row without input fields."""
    m = as_object(jp.strict_json(F.col(row)))
    body = as_object(F.element_at(F.col("_m"), "input"))
    bare = F.map_filter(F.col("_m"), lambda k, v: ~k.isin(ROW_META))
    data = F.when(filled(body), body).otherwise(bare)
    ident = slug(scalar_text(F.element_at(F.col("_m"), "id")))
    kind = scalar_text(F.element_at(F.col("_m"), "kind"))
    context = as_object(F.element_at(F.col("_m"), "context"))
    cases = rows.withColumn("_m", m).select(
        key, F.col(index).alias("_i"),
        F.when(ident.rlike(ID_OK), ident).otherwise(F.concat(F.lit("row-"), F.col(index).cast("string"))).alias("case_id"),
        F.when(kind == "", "dataset").otherwise(kind).alias("kind"),
        F.when(filled(data), object_text(data)).alias("input"),
        F.when(filled(context), object_text(context)).alias("context"),
        F.when(~filled(data), F.concat(F.lit("dataset row "), F.col(index).cast("string"),
                                       F.lit(" has no input fields"))).alias("reason"))
    return dedup_ids(cases, within=[key]).withColumnRenamed("_i", index)


# ---- TXT-7: case validation ------------------------------------------------------------

def validate_cases(cases: DataFrame, key: str, index: str, case: str = "case",
                   known_fields: list[str] = (), max_id: int | None = None) -> DataFrame:
    """(key, index, id, kind, input, reason) per written case; NULL reason: accepted. An id that
    an earlier case of the group has is rejected."""
    m = as_object(jp.strict_json(F.col(case)))
    ident = py_strip(scalar_text(F.element_at(F.col("_m"), "id")))
    data = as_object(F.element_at(F.col("_m"), "input"))
    rows = cases.withColumn("_m", m).select(
        key, index, F.col("_m").isNull().alias("_none"), ident.alias("id"), data.alias("_data"),
        F.lower(py_strip(scalar_text(F.element_at(F.col("_m"), "kind")))).alias("_kind"))
    firsts = rows.where(~F.col("_none")).groupBy(key, "id").agg(F.min(index).alias("_first"))
    j = rows.join(firsts, [key, "id"], "left")
    bad_id = ~F.col("id").rlike(ID_OK) | F.contains(F.col("id"), F.lit(".."))
    if max_id:
        bad_id = bad_id | (F.length("id") > max_id)
    reason = (F.when(F.col("_none"), "not an object").when(bad_id, "unusable id")
              .when(F.col("_first") < F.col(index), "id used more than once")
              .when(~filled(F.col("_data")), "no input object"))
    if known_fields:
        fields = F.array(*[F.lit(f) for f in known_fields])
        reason = reason.when(~F.arrays_overlap(F.map_keys("_data"), fields), "no known request field")
    return j.select(key, index, "id",
                    F.when(F.col("_kind").isin(KINDS), F.col("_kind")).otherwise("nominal").alias("kind"),
                    F.when(filled(F.col("_data")), object_text(F.col("_data"))).alias("input"),
                    reason.alias("reason"))


# ---- TXT-8 / SRC-5: spec assembly and its inverse ---------------------------------------

def spec_rows(intents: DataFrame, cases: DataFrame, key: str = "doc_id", order: str = "intent_order") -> DataFrame:
    """One row per emitted case: key, place (emission order, from 0), suite_id, case_id, input,
    context and its check. ``intents``: key, intent_id, ``order``, requirement_ref, how,
    template, params, threshold. ``cases``: key, intent_id, case_order, case_id, input (JSON
    text), context; a case with an empty input is left out, and an intent left without cases
    gets the deterministic one."""
    usable = cases.where("input is not null and input <> '{}'").select(
        key, "intent_id", "case_order", F.col("case_id").alias("_case"), "input", "context")
    prompt = py_strip(F.concat(F.lit("A representative request that should be handled normally. Under test: "),
                               F.coalesce("assertion", F.lit("the assertion"))))
    j = intents.join(usable, [key, "intent_id"], "left")
    own = F.col("_case").isNotNull()
    path = F.col("intent_id")
    how = F.col("how")
    with_ = (F.when(how == "template", F.coalesce("params", F.lit("{}")))
             .when((how == "judge") & F.col("threshold").isNotNull(),
                   F.concat(F.lit('{"threshold":'), F.col("threshold").cast("string"), F.lit("}")))
             .otherwise(F.lit("{}")))
    rows = j.select(
        key, F.coalesce("requirement_ref", F.lit("unmapped")).alias("suite_id"),
        F.struct(order, F.coalesce("case_order", F.lit(0)).alias("c")).alias("_o"),
        strip_chars(F.regexp_replace(F.concat_ws("-", path, F.coalesce("_case", F.lit("nominal"))), ID_UNSAFE, "-"),
                    "-.").alias("case_id"),
        F.when(own, F.col("input")).otherwise(F.to_json(F.struct(prompt.alias("prompt")))).alias("input"),
        F.when(own, F.col("context")).alias("context"), how.alias("type"),
        F.when(how == "template", F.col("template"))
         .when(how == "generated", F.concat(F.lit("generated/checks/"), path, F.lit(".py"))).alias("uses"),
        F.when(how == "judge", "primary").alias("judge"),
        F.when(how == "judge", F.concat(F.lit("generated/rubrics/"), path, F.lit(".yaml"))).alias("rubric"),
        with_.alias("with"))
    # the place within one group's spec: a person's or a builder's list of cases
    place = F.row_number().over(Window.partitionBy(key).orderBy("_o")) - 1
    return dedup_ids(rows.withColumn("place", place).drop("_o"), index="place", within=[key])


CONFIG = ("struct<suites:array<struct<id:string,requirement_ref:string,cases:array<struct<id:string,"
          "input:string,checks:array<struct<type:string,uses:string,judge:string,rubric:string,"
          "`with`:string>>>>>>>")


def assemble(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, config): one nested config per group, one suite per requirement, suites and cases in
    order of emission."""
    check = F.array(F.struct("type", "uses", "judge", "rubric", "with"))
    case = F.struct("place", F.struct(F.col("case_id").alias("id"), "input", check.alias("checks")).alias("case"))
    suites = rows.groupBy(key, "suite_id").agg(F.array_sort(F.collect_list(case), _by("place")).alias("cs"))
    suite = F.struct(F.get("cs", F.lit(0))["place"].alias("place"), F.struct(
        F.col("suite_id").alias("id"), F.col("suite_id").alias("requirement_ref"),
        F.transform("cs", lambda c: c["case"]).alias("cases")).alias("suite"))
    return suites.groupBy(key).agg(F.array_sort(F.collect_list(suite), _by("place")).alias("ss")).select(
        key, F.to_json(F.struct(F.transform("ss", lambda s: s["suite"]).alias("suites"))).alias("config"))


def _by(field: str):
    def order(a: Column, b: Column) -> Column:
        return F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)
    return order


def config_checks(versions: DataFrame, key: str, artifacts: DataFrame | None = None) -> DataFrame:
    """SRC-5: one row per check of every stored config, with its determinism and, where
    ``artifacts`` (key, path, body) has it, the source or rubric it names."""
    t = versions.select(key, F.from_json("config", CONFIG).alias("c"))
    t = t.select(key, F.posexplode("c.suites").alias("suite_pos", "s"))
    t = t.select(key, "suite_pos", F.col("s.id").alias("suite_id"), F.posexplode("s.cases").alias("case_pos", "k"))
    t = t.select(key, "suite_pos", "suite_id", "case_pos", F.col("k.id").alias("case_id"),
                 F.posexplode("k.checks").alias("check_index", "x"))
    kind = F.coalesce("x.type", F.lit("template"))
    named = F.when(kind == "generated", F.coalesce("x.uses", F.lit(""))).when(
        kind == "judge", F.coalesce("x.rubric", F.lit("")))
    out = t.select(key, "suite_pos", "case_pos", "suite_id", "case_id", "check_index", kind.alias("type"),
                   determinism(kind).alias("determinism"), named.alias("key"), F.col("x.uses").alias("uses"),
                   F.col("x.judge").alias("judge"), F.col("x.rubric").alias("rubric"),
                   F.coalesce("x.with", F.lit("{}")).alias("params"))
    if artifacts is None:
        return out
    bodies = artifacts.select(key, F.col("path").alias("key"), F.col("body").alias("artifact"))
    return out.join(bodies, [key, "key"], "left")


# A version is a tree of suites, cases and checks; each node is hashed over its id and the hashes
# of its children in order, so equal parts have equal hashes wherever they are, and an edit
# changes the nodes on one path only. What one aggregation gathers are the children of one node.
_LEVELS = ["check", "case", "suite", "version"]
_PLACE = ["suite_pos", "case_pos", "check_index"]


def _check_nodes(checks: DataFrame, key: str) -> DataFrame:
    text = F.concat_ws("\x1f", F.col("check_index").cast("string"), "type", F.coalesce("uses", F.lit("")),
                       F.coalesce("rubric", F.lit("")), "params")
    return checks.select(key, F.lit("check").alias("level"), "suite_pos", "case_pos", F.col("check_index").cast("int"), "suite_id",
                         "case_id", F.sha2(text, 256).alias("hash"), F.lit(1).cast("long").alias("n"))


def _parents(nodes: DataFrame, key: str, level: str) -> DataFrame:
    """The nodes of ``level`` from all their children."""
    depth = 3 - _LEVELS.index(level)  # how many positions name a node of this level
    own, at = _PLACE[:depth], _PLACE[depth]
    ids = ["suite_id", "case_id"][:depth]
    name = F.col(ids[-1]) if ids else F.lit(None).cast("string")
    g = nodes.groupBy(key, *own).agg(
        *[F.first(i).alias(i) for i in ids], F.sum("n").alias("n"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(at, "hash"))), lambda x: x["hash"]), "\n").alias("_children"))
    missing = {c: F.lit(None).cast("int") for c in _PLACE[depth:]} | {
        c: F.lit(None).cast("string") for c in ["suite_id", "case_id"][depth:]}
    return g.withColumns({**missing, "level": F.lit(level), "hash": F.sha2(F.concat_ws("\n", name, "_children"), 256)}).select(
        key, "level", *_PLACE, "suite_id", "case_id", "hash", "n")


def hash_tree(checks: DataFrame, key: str) -> DataFrame:
    """SCL-3: every node of every version: key, level (check, case, suite, version), its place and ids,
    hash, n (checks below it)."""
    nodes = tree = _check_nodes(checks, key)
    for level in _LEVELS[1:]:
        nodes = _parents(nodes, key, level)
        tree = tree.unionByName(nodes)
    return tree


def rehash(tree: DataFrame, checks: DataFrame, edited: DataFrame, key: str) -> DataFrame:
    """The tree after an edit. ``checks``: the flattened checks as they are now; ``edited``: key,
    suite_id, case_id, check_index of those that changed. Hashed again are these checks and the
    nodes above them, from the stored hashes of their other children."""
    at = [key, "suite_id", "case_id", "check_index"]
    checkpoint_dir(checks.sparkSession)
    changed = _check_nodes(checks.join(edited.select(*at), at, "left_semi"), key).checkpoint()
    out = siblings = None
    for level in _LEVELS:
        depth = 3 - _LEVELS.index(level)
        own = [key, *_PLACE[:depth]]
        old = tree.where(F.col("level") == level)
        if level != "check":
            touched = changed.select(*own).distinct()
            below = siblings.join(touched, own, "left_semi")
            # kept: the next level reads it three times
            changed = _parents(below, key, level).checkpoint()
        now = old.join(changed.select(*own).distinct(), own, "left_anti").unionByName(changed)
        out = now if out is None else out.unionByName(now)
        siblings = now
    return out


def shared_nodes(tree: DataFrame, key: str, level: str) -> DataFrame:
    """(hash, versions): nodes of a level whose content several versions hold."""
    nodes = tree.where(F.col("level") == level).select("hash", key).distinct()
    return nodes.groupBy("hash").agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")


# A version is a tree of suites, cases and checks; each node is hashed over its id and the hashes
# of its children in order, so equal parts have equal hashes wherever they are, and an edit
# changes the nodes on one path only. What one aggregation gathers are the children of one node.
_LEVELS = ["check", "case", "suite", "version"]
_PLACE = ["suite_pos", "case_pos", "check_index"]


def _check_nodes(checks: DataFrame, key: str) -> DataFrame:
    text = F.concat_ws("\x1f", F.col("check_index").cast("string"), "type", F.coalesce("uses", F.lit("")),
                       F.coalesce("rubric", F.lit("")), "params")
    return checks.select(key, F.lit("check").alias("level"), "suite_pos", "case_pos", F.col("check_index").cast("int"), "suite_id",
                         "case_id", F.sha2(text, 256).alias("hash"), F.lit(1).cast("long").alias("n"))


def _parents(nodes: DataFrame, key: str, level: str) -> DataFrame:
    """The nodes of ``level`` from all their children."""
    depth = 3 - _LEVELS.index(level)  # how many positions name a node of this level
    own, at = _PLACE[:depth], _PLACE[depth]
    ids = ["suite_id", "case_id"][:depth]
    name = F.col(ids[-1]) if ids else F.lit(None).cast("string")
    g = nodes.groupBy(key, *own).agg(
        *[F.first(i).alias(i) for i in ids], F.sum("n").alias("n"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(at, "hash"))), lambda x: x["hash"]), "\n").alias("_children"))
    missing = {c: F.lit(None).cast("int") for c in _PLACE[depth:]} | {
        c: F.lit(None).cast("string") for c in ["suite_id", "case_id"][depth:]}
    return g.withColumns({**missing, "level": F.lit(level), "hash": F.sha2(F.concat_ws("\n", name, "_children"), 256)}).select(
        key, "level", *_PLACE, "suite_id", "case_id", "hash", "n")


def hash_tree(checks: DataFrame, key: str) -> DataFrame:
    """SCL-3: every node of every version: key, level (check, case, suite, version), its place and ids,
    hash, n (checks below it)."""
    nodes = tree = _check_nodes(checks, key)
    for level in _LEVELS[1:]:
        nodes = _parents(nodes, key, level)
        tree = tree.unionByName(nodes)
    return tree


def rehash(tree: DataFrame, checks: DataFrame, edited: DataFrame, key: str) -> DataFrame:
    """The tree after an edit. ``checks``: the flattened checks as they are now; ``edited``: key,
    suite_id, case_id, check_index of those that changed. Hashed again are these checks and the
    nodes above them, from the stored hashes of their other children."""
    at = [key, "suite_id", "case_id", "check_index"]
    checkpoint_dir(checks.sparkSession)
    changed = _check_nodes(checks.join(edited.select(*at), at, "left_semi"), key).checkpoint()
    out = siblings = None
    for level in _LEVELS:
        depth = 3 - _LEVELS.index(level)
        own = [key, *_PLACE[:depth]]
        old = tree.where(F.col("level") == level)
        if level != "check":
            touched = changed.select(*own).distinct()
            below = siblings.join(touched, own, "left_semi")
            # kept: the next level reads it three times
            changed = _parents(below, key, level).checkpoint()
        now = old.join(changed.select(*own).distinct(), own, "left_anti").unionByName(changed)
        out = now if out is None else out.unionByName(now)
        siblings = now
    return out


def shared_nodes(tree: DataFrame, key: str, level: str) -> DataFrame:
    """(hash, versions): nodes of a level whose content several versions hold."""
    nodes = tree.where(F.col("level") == level).select("hash", key).distinct()
    return nodes.groupBy("hash").agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")


def content_hashes(checks: DataFrame, key: str) -> DataFrame:
    """(key, content_hash, n_checks) of each version: the root of its hash tree."""
    return hash_tree(checks, key).where("level = 'version'").select(
        key, F.col("hash").alias("content_hash"), F.col("n").alias("n_checks"))


# ---- TXT-11: config edits ---------------------------------------------------------------

def edit_checks(checks: DataFrame, versions: DataFrame, edits: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Replace the params of single checks. ``edits``: edit_id, key, suite_id, case_id,
    check_index, params; ``versions``: key, status. Returns the checks after all accepted edits
    (the latest edit of a check wins) and every edit with its reject reason."""
    at = [key, "suite_id", "case_id", "check_index"]
    places = checks.select(*at).withColumn("_found", F.lit(True))
    sizes = checks.groupBy(key, "suite_id", "case_id").agg(F.count(F.lit(1)).alias("_n"))
    e = (edits.join(versions.select(key, "status"), key, "left").join(places, at, "left")
         .join(sizes, [key, "suite_id", "case_id"], "left"))
    reason = (F.when(F.col("status").isNull(), "version not found")
              .when(F.col("status") != "draft", F.concat(F.lit("only drafts can be edited, status: "), "status"))
              .when(F.col("_n").isNull(), "check not found")
              .when(F.col("_found").isNull(), "check_index out of range"))
    judged = e.withColumn("reason", reason).select("edit_id", *at, "params", "reason")
    last = judged.where("reason is null").groupBy(*at).agg(F.max_by("params", "edit_id").alias("_new"))
    return (checks.join(last, at, "left").withColumn("params", F.coalesce("_new", "params")).drop("_new"), judged)


# ---- TXT-12: version import -------------------------------------------------------------

def import_versions(specs: DataFrame, files: DataFrame, existing: DataFrame, key: str = "doc_id",
                    pipeline: str = "pipeline") -> DataFrame:
    """New draft versions from specs: (key, pipeline, version_number, status, n_sources,
    n_rubrics, content_hash). ``specs``: key (of one spec each), pipeline, config; ``files``: key, path, body, of
    which only those a check names are taken; ``existing``: pipeline, version_number. Specs of
    one pipeline are numbered in order of their key."""
    checks = config_checks(specs, key, files)
    named = checks.where("key is not null").select(key, "type", "key", "artifact").distinct()
    taken = named.groupBy(key).agg(
        F.count_if((F.col("type") == "generated") & F.col("artifact").isNotNull()).alias("n_sources"),
        F.count_if((F.col("type") == "judge") & F.col("artifact").isNotNull()).alias("n_rubrics"),
        F.array_sort(F.collect_list(F.when(F.col("artifact").isNotNull(), F.struct("key", "artifact")))).alias("_a"))
    body = F.array_join(F.transform("_a", lambda x: F.concat_ws("=", x["key"], x["artifact"])), "\n")
    top = existing.groupBy(pipeline).agg(F.max("version_number").alias("_top"))
    nth = numbered(specs.select(pipeline, key), pipeline, key, "_nth").drop(pipeline)
    return (specs.join(taken, key, "left").join(nth, key).join(top, pipeline, "left").select(
        key, pipeline, (F.coalesce("_top", F.lit(0)) + F.col("_nth")).cast("long").alias("version_number"),
        F.lit("draft").alias("status"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.coalesce("n_rubrics", F.lit(0)).alias("n_rubrics"),
        canonical_hash(F.col("config"), F.coalesce(body, F.lit(""))).alias("content_hash")))


# ---- AGG-17: build preview --------------------------------------------------------------

def build_preview(intents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, checks, estimated_minutes): two minutes at least, one per check."""
    return intents.groupBy(key).agg(F.count(F.lit(1)).alias("checks")).withColumn(
        "estimated_minutes", F.greatest(F.lit(2).cast("long"), F.col("checks")))
