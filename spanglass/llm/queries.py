"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanglass.llm import decontaminate, divergence, fill_middle, html_text, language, licenses, neighbours, ngram_join, repeats, secrets, sentencepieces, token_files, warc

#: A public model; any SentencePiece model of the supported kinds can be given instead.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.contamination(docs, items, into="s")
    return found.select(
        "doc_id",
        "s.n_words",
        "s.n_hit",
        F.size("s.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("s.items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated("s").alias("contaminated"),
    )


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents", "doc_id", "text"), into="s")
    of = lambda *kinds: F.filter("s", lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.spans_text(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        secrets.spans_text(F.col("s")).alias("spans"),
    )


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return pages.select("page_id", "url", html_text.extracted("html").alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    manifest = warc.write_archives(pages, warc.archive_folder(spark))
    return warc.read_archives(spark, manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op7_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f
"""


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    model = sentencepieces.share_model(spark, model_path)
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("e", sentencepieces.encoded_and_checked("text", model))
    ids = F.array_join(F.transform("e.ids", lambda k: k.cast("string")), ",")
    return docs.select(
        "doc_id",
        F.size("e.ids").cast("bigint").alias("n_ids"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.col("e.exact").alias("round_trip"),
    )


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents", "doc_id", "text"))


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
_GRAMS = "list_sort(list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])))"
_WORDS = "list_filter(string_split(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
ORACLE["op4_licenses"] = f"""
WITH t AS (SELECT license, {_GRAMS.format("w")} AS g FROM (SELECT license, {_WORDS.format("body")} AS w FROM (VALUES {_TEMPLATE_ROWS}) AS v(license, body))),
l AS (SELECT doc_id, text, regexp_split_to_array(text, '[\\r\\n]+') AS parts FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(CASE WHEN len(parts) > 1 THEN list_append(parts, text) ELSE parts END) AS segment FROM l),
g AS (SELECT DISTINCT doc_id, {_GRAMS.format("w")} AS g FROM (SELECT doc_id, {_WORDS.format("segment")} AS w FROM s)),
m AS (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice FROM g, t
      WHERE len(g.g) BETWEEN len(t.g) / 2 AND len(t.g) * 2)
SELECT doc_id, license, max(dice) AS dice, count(*) AS n_segments FROM m WHERE dice >= {licenses.THRESHOLD} GROUP BY ALL
"""


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = language.with_language(docs, language.fit_language_model(docs), into="l")
    return found.select("doc_id", language.held_out().alias("held_out"), F.col("l.lang").alias("lang_pred"), "l.score")


@query
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents", "text", "lang", "source"))


ORACLE["op11_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(s), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS s FROM c GROUP BY ALL) USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 1)) // (g.total::HUGEINT + v.v) AS p,
        1 + (1000000000 * (kept.n::HUGEINT + 1)) // (v.total::HUGEINT + v.v) AS of_lang
      FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT g.lang, g.source, h.source AS item FROM g JOIN g AS h ON g.lang = h.lang AND g.source <> h.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pair LEFT JOIN f USING (lang, source, item)
      UNION ALL SELECT lang, source, 'term', term, ((p - of_lang) * (p - of_lang) // of_lang)::BIGINT FROM p WHERE n > 0 AND p > of_lang)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""


#: A model that drops white space, so words between blanks are encoded one by one.
WORD_MODEL, END_ID = public_tokenizers.path("word_bpe_49k.json"), 2


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    manifest = token_files.write_token_files(docs, token_files.file_folder(spark), WORD_MODEL, end_id=END_ID, words=True)
    return token_files.read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    found = fill_middle.restored(found)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


ORACLE["op13_fill_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+' AS re FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, re) AS w, list_transform([1, 9, 17, 25], lambda k: ('0x' || h[k:k + 7])::BIGINT) AS d FROM t),
v AS (SELECT doc_id, t, w, len(w) AS n, list_sort([d[1] % (len(w) + 1), d[2] % (len(w) + 1)]) AS cut,
        CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT doc_id, t, n, form, coalesce(list_aggregate(w[1:cut[1]], 'string_agg', ''), '') AS a, coalesce(list_aggregate(w[cut[1] + 1:cut[2]], 'string_agg', ''), '') AS b FROM v),
y AS (SELECT *, t[length(a) + length(b) + 1:] AS c FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM y
"""
