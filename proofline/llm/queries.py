"""The registered queries of this subpackage (opN_<name>) and the SQL of those SQL can state."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql.strip()
        return fn
    return deco


@query("""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.llm.exact_dedup import exact_groups
    return exact_groups(table(spark, sf_dir, "documents"))


@query()
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.llm.simhash import simhash_groups
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id")


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from proofline.llm import sentencepiece_codec as sp
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = sp.decode(sp.encode(table(spark, sf_dir, "documents"), model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(sp.ids_text(), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


@query()
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from proofline.llm import token_files
    rows = token_files.written_and_read(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.llm import langid
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, learn=langid.for_training())
    p = langid.predict(docs, model)
    return p.select("doc_id", (~langid.for_training()).alias("held_out"), "lang_pred", "score",
                    "ambiguous")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.llm import toxicity
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=toxicity.for_training())
    s = toxicity.score(docs, model)
    return s.select("doc_id", (~toxicity.for_training()).alias("held_out"), "score", "predicted")


def shares_of() -> dict[str, int]:
    """Target shares of the ``documents`` sources: src0 (a third of the rows) a tenth of the
    mixture, the rest falling from src1 to src19."""
    return {"src0": 25} | {f"src{i}": 21 - i for i in range(1, 20)}


@query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"), shares_of()).select(
        "doc_id", "source", "block", "slot", "place", "phase")


@query()
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.llm.embedding_dedup import embedding_groups
    return embedding_groups(table(spark, sf_dir, "embeddings"))


# ---- URL list: derived from the pages, since no table holds one ----------------------------
# fetched_at: 2024-01-01 plus (page_id * 37 % 525600) minutes. For every host, h is the number
# of the first four hex digits of its md5. Domain entries for hosts with h % 4 = 0: four
# changes, add and remove in turn, the i-th at (h * (i + 3) * 7919 % 525600) minutes. Prefix
# entries for host/language with h % 5 = 0: one add. The category is by h % 3.
_HEX = "0123456789abcdef"


def capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    minutes = (F.col("page_id") * 37) % 525600
    return pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + minutes * 60))


def url_list(captures: DataFrame) -> DataFrame:
    from proofline.llm.url_filter import host_of, path_of
    hosts = captures.select(host_of(F.col("url")).alias("host"),
                            F.split(path_of(F.col("url")), "/").getItem(1).alias("seg"))
    digest = F.md5("host")
    h = sum((F.instr(F.lit(_HEX), F.substring(digest, i + 1, 1)) - 1) * 16 ** (3 - i)
            for i in range(4)).cast("long")
    category = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")),
                            (F.col("h") % 3 + 1).cast("int"))

    def minutes(i):
        return F.timestamp_seconds(F.lit(1704067200) + F.col("h") * (i + 3) * 7919 % 525600 * 60)
    one = hosts.where("host is not null").withColumn("h", h)
    domains = (one.select("host", "h").distinct().where("h % 4 = 0")
               .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
               .select(F.lit("domain").alias("kind"), F.col("host").alias("value"),
                       category.alias("category"),
                       F.when(F.col("i") % 2 == 0, "add").otherwise("remove").alias("action"),
                       minutes(F.col("i")).alias("at")))
    prefixes = (one.where("h % 5 = 0 and seg <> ''").select("host", "h", "seg").distinct()
                .select(F.lit("prefix").alias("kind"), F.concat_ws("/", "host", "seg").alias("value"),
                        category.alias("category"), F.lit("add").alias("action"),
                        minutes(F.lit(4)).alias("at")))
    return domains.union(prefixes)


_SQL_H = " + ".join(f"(instr('{_HEX}', substr(md5(host), {i + 1}, 1)) - 1) * {16 ** (3 - i)}"
                    for i in range(4))
_SQL_AT = "TIMESTAMP '2024-01-01' + to_minutes(CAST(h * ({i} + 3) * 7919 % 525600 AS BIGINT))"
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"


@query(rf"""
WITH cap AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id * 37 % 525600 AS BIGINT)) AS fetched_at,
         nullif(lower(regexp_replace(regexp_extract(url, '{_SCHEME}(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', '')), '') AS host,
         list_filter(string_split(regexp_extract(url, '{_SCHEME}[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segs,
         string_split(regexp_extract(url, '{_SCHEME}[^/?#]*([^?#]*)', 1), '/')[2] AS seg
  FROM pages),
hosts AS (SELECT host, seg, CAST({_SQL_H} AS BIGINT) AS h FROM cap WHERE host IS NOT NULL),
entries AS (
  SELECT 'domain' AS kind, host AS value, h, i % 2 = 0 AS is_add, {_SQL_AT.format(i="i")} AS ts
  FROM (SELECT DISTINCT host, h FROM hosts WHERE h % 4 = 0), range(4) r(i)
  UNION ALL
  SELECT 'prefix', host || '/' || seg, h, TRUE, {_SQL_AT.format(i="4")}
  FROM (SELECT DISTINCT host, seg, h FROM hosts WHERE h % 5 = 0 AND seg <> '')),
state AS (SELECT kind, value, ['adult', 'malware', 'spam'][h % 3 + 1] AS category, ts, bool_or(is_add) AS is_on
          FROM entries GROUP BY ALL),
listed AS (SELECT * FROM (SELECT *, lead(ts) OVER (PARTITION BY kind, value, category ORDER BY ts) AS valid_to
                          FROM state) WHERE is_on),
keys AS (
  SELECT page_id, fetched_at, 'domain' AS kind,
         unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
                lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS value FROM cap WHERE host IS NOT NULL
  UNION ALL
  SELECT page_id, fetched_at, 'prefix',
         unnest(list_transform(range(1, len(segs) + 1), lambda i: host || '/' || array_to_string(segs[1:i], '/')))
  FROM cap WHERE host IS NOT NULL),
hit AS (
  SELECT k.page_id, count(*) AS n, string_agg(DISTINCT l.category, ',' ORDER BY l.category) AS c, min(l.ts) AS since
  FROM keys k JOIN listed l ON k.kind = l.kind AND k.value = l.value AND k.fetched_at >= l.ts
       AND (l.valid_to IS NULL OR k.fetched_at < l.valid_to) GROUP BY 1)
SELECT page_id, host, fetched_at, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_matches,
       coalesce(c, '') AS categories, since AS listed_since
FROM cap LEFT JOIN hit USING (page_id)
""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.llm.url_filter import judged
    captures = capture_times(spark, sf_dir)
    out = judged(captures, url_list(captures))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("fetched_at", "listed_since")})


@query(r"""
WITH lines AS (
  SELECT doc_id, i AS line, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE regexp_matches(x, '[^ \t\r]')),
two AS (SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM lines),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, pos) > 1
            AND length(x) - length(replace(x, ' ', '')) + 1 >= 50 AS single,
         y IS NOT NULL AND row_number() OVER (PARTITION BY x, y ORDER BY doc_id, pos) > 1 AS pair
  FROM two),
gone AS (
  SELECT doc_id, line FROM (
    SELECT *, single OR pair OR coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY pos), FALSE) AS del
    FROM ranked) WHERE del),
rest AS (
  SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t, count(*) FILTER (regexp_matches(x, '[^ \t\r]')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) a
  ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.line GROUP BY 1),
sizes AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines, 0) - coalesce(n, 0) AS n_deleted,
       sha256(coalesce(t, '')) AS text_sha256
FROM documents d LEFT JOIN rest USING (doc_id) LEFT JOIN sizes USING (doc_id)
""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.llm.line_dedup import line_dedup
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


# ---- clustering and coding of vectors, in SQL round by round -------------------------------
# A finite vector: its components as doubles; floor(scale * x) as integers, which doubles hold.
def _sql_vectors(scale: int, where: str) -> str:
    return f"""SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND {where}
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


_NEAR = "CAST(list_dot_product(v.{q}, v.{q}) - 2 * list_dot_product(v.{q}, c.q) + list_dot_product(c.q, c.q) AS BIGINT)"


def _sql_means(rows: str, group: str, value: str, old: str) -> str:
    """Componentwise floor of the mean per group; a group without rows keeps its old value."""
    return f"""SELECT {group}, coalesce(m.q, o.q) AS q FROM {old} o LEFT JOIN (
    SELECT {group}, list(y ORDER BY i) AS q FROM (
      SELECT {group}, i, floor(sum({value}[i]) / count(*)) AS y FROM {rows}, range(1, 1 + len({value})) r(i) GROUP BY {group}, i)
    GROUP BY {group}) m USING ({group})"""


def _sql_clusters(k: int, dims: int, scale: int, rounds: int) -> str:
    near = _NEAR.format(q="q")
    steps = [f"v AS MATERIALIZED ({_sql_vectors(scale, f'len(embedding) = {dims}')})",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q FROM
  (SELECT sha256('1:' || vec_id) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, q, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM
  (SELECT v.vec_id, v.q, c.cluster, {near} AS d FROM v, c{r} c) GROUP BY vec_id, q)""")
        steps.append(f"c{r + 1} AS MATERIALIZED ({_sql_means(f'a{r}', 'cluster', 'q', f'c{r}')})")
    del steps[-1]
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.q, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)"""


@query(_sql_clusters(16, 64, 64, 3))
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.llm import centroids
    return centroids.with_inertia(*centroids.centroid_clusters(table(spark, sf_dir, "embeddings")))


def _sql_codes(parts: int, entries: int, scale: int, rounds: int) -> str:
    near = _NEAR.format(q="x")
    steps = [f"k AS MATERIALIZED ({_sql_vectors(scale, f'len(embedding) > 0 AND len(embedding) % {parts} = 0')})",
             f"""v AS MATERIALIZED (SELECT vec_id, label, p, q[p * len(q) // {parts} + 1:(p + 1) * len(q) // {parts}] AS x
  FROM k, range({parts}) r(p) WHERE len(q) = (SELECT len(q) FROM k GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1))""",
             f"""c0 AS MATERIALIZED (SELECT p, n AS entry, p * 1000 + n AS slot, x AS q FROM
  (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS n FROM v) WHERE n < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, label, p, x, arg_min(slot, (d, slot)) AS slot, min(d) AS d FROM
  (SELECT v.*, c.slot, {near} AS d FROM v JOIN c{r} c ON c.p = v.p) GROUP BY vec_id, label, p, x)""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT slot // 1000 AS p, slot % 1000 AS entry, slot, q FROM
  ({_sql_means(f'a{r}', 'slot', 'x', f'c{r}')}))""")
    del steps[-1]
    return "WITH " + ",\n".join(steps) + f""",
 e AS (SELECT vec_id, label, string_agg(printf('%02x', slot % 1000), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
       FROM a{rounds} GROUP BY vec_id, label),
 s AS (SELECT sha256(string_agg(array_to_string(list_transform(q, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY slot)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM e, s"""


@query(_sql_codes(4, 256, 1024, 4))
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.llm import vector_codes
    rows, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(rows).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


@query()
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.llm import licenses
    return licenses.scan(table(spark, sf_dir, "documents")).drop("notices")
