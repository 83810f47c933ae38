"""The queries of this subpackage over the tables of a folder, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilflow.llm import content_sort, decontamination, licenses, near_dedup, neighbours, sentencepiece_bpe, severity, sharding, spelling, substrings, token_rollups, warc, whitening
from veilflow.llm.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_interleaved(table(spark, sf_dir, "documents"), n_shards=24, seed=7)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "source_rank"
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def capture_log(pages: DataFrame) -> DataFrame:
    """Every page as captures of its address and of its site's front page, and later answers that these have not changed.

    Captures of a page: as it is, and a little later with another body, under another spelling of its address.  The answers, one for the page and one for
    the front page, name the first body, the second, or one that was never captured; some come before any capture; some records lack a tag, a date
    or both.  A front page changes with every capture, and has as many of them as its site has pages.
    """
    # Bodies are read and hashed once; what follows holds ids, addresses and hashes.
    rows = pages.select(F.col("page_id").cast("long").alias("n"), "url", F.md5(F.coalesce("html", F.lit(""))).alias("body"), F.md5(F.concat(F.coalesce("html", F.lit("")), F.lit("2"))).alias("other"))
    rows = rows.withColumn("never", F.md5(F.lit("never")))
    n, body, other, never = (F.col(c) for c in ("n", "body", "other", "never"))
    front = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/index.html"))
    spelled = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.instr("url", "?") > 0, "&").otherwise("?"), F.lit("utm_medium=mail#x"))

    def headers(v, tag, date, **more: str):
        names = ["etag", "last-modified", *more]
        values = [F.when(tag, F.concat(F.lit('"'), F.substring(v, 1, 12), F.lit('"'))), F.when(date, F.substring(v, 13, 12)), *map(F.lit, more.values())]
        return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values)), lambda k, x: x.isNotNull())

    def record(k: int, kind: str, url, at, v, tag, date, status: int, **more: str):
        return F.struct(
            (n * 5 + k).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), (n + at).cast("double").alias("date"), headers(v, tag, date, **more).alias("headers"), v.alias("digest"), F.lit(status).alias("status")
        )

    named = F.when(n % 7 == 6, never).when(n % 3 == 0, other).otherwise(body)
    records = F.array(
        record(0, "response", F.col("url"), 0.0, body, n % 3 != 0, n % 4 != 0, 200, age="0", server="a"),
        record(1, "response", spelled, 0.25, other, n % 5 != 0, n % 2 != 0, 200, age="1", server="b"),
        record(2, "response", front, 0.5, body, n % 3 != 1, n % 4 != 1, 200, age="2", server="c"),
        record(3, "revisit", F.col("url"), F.when(n % 11 == 0, -0.5).otherwise(0.75), named, n % 5 != 1, n % 2 == 0, 304, age="3600", connection="close"),
        record(4, "revisit", front, 0.875, F.when(n % 2 == 0, body).otherwise(never), n % 3 != 2, n % 5 != 2, 304, age="7200"),
    )
    return rows.select(F.explode(records).alias("r")).select("r.*")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(capture_log(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical_url", "refers_to", "status", F.col("headers")["etag"].alias("etag"), F.col("headers")["age"].alias("age"), F.col("headers")["server"].alias("server"), F.size("headers").alias("n_headers"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(table(spark, sf_dir, "documents"), length=35)


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in, toxic ones are deleted, low-quality ones are counted anew without repeated lines."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scratch = Scratch(spark)
    rollups = token_rollups.Rollups(spark, scratch.path("rollups"))
    lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    # Both counts come from one pass over the texts; only ids and numbers are joined.
    counts = scratch.cut(token_rollups.count_tokens(docs, revised=lines), "counts")
    rollups.commit("0001", counts.select(F.lit("insert").alias("op"), "doc_id", *token_rollups.KEYS, "n_tokens"))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    gone = counts.join(toxic, "doc_id").select(F.lit("delete").alias("op"), "doc_id", *token_rollups.KEYS, F.lit(None).cast("long").alias("n_tokens"))
    rollups.commit("0002", gone)
    low = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 0 and toxic = 0").select("doc_id")
    rollups.commit("0003", counts.join(low, "doc_id").select(F.lit("revise").alias("op"), "doc_id", *token_rollups.KEYS, F.col("n_revised").alias("n_tokens")))
    rollups.commit("0002", gone)  # delivered twice, counted once
    return scratch.last(rollups.totals())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = severity.fit_severity(severity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return severity.score_severity(docs, model)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=4)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0
), ns AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, ns, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
), hits AS (
  SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, win)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS u(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(x.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items x USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_interleaved": op1_shard_interleaved,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_license_scan": op5_license_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_near_dedup": op7_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_rollups": op9_token_rollups,
    "op10_toxicity": op10_toxicity,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS u(i) WHERE len(w) >= 35
), rep AS (
  SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM win JOIN rep USING (h), unnest(range(i, i + 35)) AS u(p)
), g AS (
  SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id
), words AS (
  SELECT d.doc_id, p, d.w[p] AS word FROM d, unnest(range(1, len(d.w) + 1)) AS u(p)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP1_SQL = r"""
WITH crc AS (
  SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(n)) q
), d AS (
  SELECT doc_id, source, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS stratum FROM documents
), c AS (
  SELECT doc_id, source, stratum, ('0x' || substr(md5('7|' || stratum), 1, 15))::BIGINT AS tie, len(b)::BIGINT + 8 AS size,
    xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(b, lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(tab[xor(c, x) % 256 + 1], c >> 8))) AS text_crc32
  FROM d, crc
), s AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '-') || '|' || text_crc32), 1, 15))::BIGINT, doc_id, text_crc32, size) AS source_rank,
    count(*) OVER (PARTITION BY stratum) AS n
  FROM c
), o AS (
  SELECT *, row_number() OVER (ORDER BY (source_rank::DOUBLE - tie::DOUBLE / 1152921504606846976.0::DOUBLE) / n::DOUBLE, tie, stratum, source_rank) - 1 AS position, count(*) OVER () AS n_rows FROM s
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * 24 // n_rows)::INT AS shard, position - ((position * 24 // n_rows) * n_rows + 23) // 24 AS slot, NULL::INT AS grown_shard, source, source_rank FROM o
"""

OP4_SQL = r"""
WITH p AS (
  SELECT page_id AS n, url, md5(coalesce(html, '')) AS b, md5(coalesce(html, '') || '2') AS o, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' AS front FROM pages
), a AS (
  SELECT n * 5 AS id, 'response' AS kind, url, n::DOUBLE AS date_, b AS v, n % 3 <> 0 AS tag, n % 4 <> 0 AS dated, 'a' AS server, '0' AS age FROM p
  UNION ALL SELECT n * 5 + 1, 'response', url, n + 0.25, o, n % 5 <> 0, n % 2 <> 0, 'b', '1' FROM p
  UNION ALL SELECT n * 5 + 2, 'response', front, n + 0.5, b, n % 3 <> 1, n % 4 <> 1, 'c', '2' FROM p
  UNION ALL SELECT n * 5 + 3, 'revisit', url, CASE WHEN n % 11 = 0 THEN n - 0.5 ELSE n + 0.75 END, CASE WHEN n % 7 = 6 THEN md5('never') WHEN n % 3 = 0 THEN o ELSE b END, n % 5 <> 1, n % 2 = 0, NULL, '3600' FROM p
  UNION ALL SELECT n * 5 + 4, 'revisit', front, n + 0.875, CASE WHEN n % 2 = 0 THEN b ELSE md5('never') END, n % 3 <> 2, n % 5 <> 2, NULL, '7200' FROM p
), c AS (
  SELECT *, regexp_replace(regexp_replace(url, '^http:', 'https:'), '^https://www\.', 'https://') AS w,
    list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|gclid|fbclid)='))) AS q FROM a
), l AS (
  SELECT id, kind, date_, v, server, age, CASE WHEN tag THEN substr(v, 1, 12) END AS e, CASE WHEN dated THEN substr(v, 13, 12) END AS m,
    regexp_replace(regexp_replace(regexp_extract(w, '^[^?#]*'), '/index\.html?$', '/'), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS u FROM c
), hit AS (
  SELECT x.id, arg_max(r.id, (r.date_, r.id)) AS h FROM l x JOIN l r ON x.kind = 'revisit' AND r.kind = 'response' AND r.u = x.u AND (r.date_ < x.date_ OR (r.date_ = x.date_ AND r.id < x.id))
    AND CASE WHEN x.e IS NOT NULL AND r.e IS NOT NULL THEN x.e = r.e WHEN x.m IS NOT NULL AND r.m IS NOT NULL THEN x.m = r.m ELSE x.v = r.v END
  GROUP BY x.id
)
SELECT x.id AS record_id, x.u AS canonical_url, h.h AS refers_to, CASE WHEN h.h IS NOT NULL THEN 200 END AS status,
  CASE WHEN h.h IS NOT NULL THEN '"' || coalesce(x.e, r.e) || '"' END AS etag, CASE WHEN h.h IS NOT NULL THEN x.age END AS age, CASE WHEN h.h IS NOT NULL THEN r.server END AS server,
  CASE WHEN h.h IS NOT NULL THEN 2 + (coalesce(x.e, r.e) IS NOT NULL)::INT + (coalesce(x.m, r.m) IS NOT NULL)::INT END AS n_headers
FROM l x LEFT JOIN hit h ON h.id = x.id LEFT JOIN l r ON r.id = h.h WHERE x.kind = 'revisit'
"""

OP11_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(n)) q
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY id, run
), hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(tab[xor(c, x) % 256 + 1], c >> 8))) AS h
  FROM counted, crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed) q
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM words, unnest(range(length(word))) AS u(i)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r FROM near
), known AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.other_n >= 10 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 10 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), led AS (
  SELECT word, word AS root, 0 AS steps FROM known
  UNION ALL SELECT l.word, k.form, l.steps + 1 FROM led l JOIN known k ON k.word = l.root WHERE k.form IS NOT NULL
)
SELECT k.word, k.form, (SELECT arg_max(l.root, l.steps) FROM led l WHERE l.word = k.word) AS root, k.n, k.n_near, k.form_n FROM known k
"""

ORACLES: dict[str, str] = {"op1_shard_interleaved": OP1_SQL, "op4_warc_revisits": OP4_SQL, "op6_decontaminate": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op11_exact_dedup": OP11_SQL, "op13_spelling_variants": OP13_SQL}
