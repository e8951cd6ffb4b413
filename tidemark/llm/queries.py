"""The registered query of each text operator, and oracle SQL where DuckDB can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, divergence, exact_dedup, lines, lm, pii, quality, secrets, simhash, toxicity, url_rules
from .common import LOWER, UPPER, documents


#: Pseudonyms of the registered query; a real run takes its own key.
KEY = b"tidemark registered query"

#: The rules of op13.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    digest = F.sha2("value", 256).alias("value_sha256")
    return found.select(F.col("id").alias("doc_id"), "position", F.length("value").alias("length"), digest, "score", "predicted")


def op2_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumnRenamed("id", "doc_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminations(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.digests(bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op7_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_documents(documents(spark, sf_dir), KEY).withColumnRenamed("id", "doc_id")


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_groups(documents(spark, sf_dir), exact_words=1).select(F.col("id").alias("doc_id"), "line_no", F.col("group").alias("group_key"), "kept")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align_documents(documents(spark, sf_dir), *paths, groups="sha256")
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).withColumnRenamed("id", "page_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_weak_label_quality,
        op3_toxicity,
        op4_decontaminate,
        op5_byte_bpe,
        op6_exact_dedup,
        op7_feistel_pii,
        op8_fuzzy_lines,
        op9_simhash_near_dedup,
        op10_lattice_lm,
        op11_source_divergence,
        op12_tokenizer_alignment,
        op13_url_filter,
    )
}

ORACLE = {
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm
    """,
    "op11_source_divergence": f"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words
            FROM documents
        ),
        docs AS (SELECT row_number() OVER () AS row, * FROM d),
        seen AS (SELECT row, lang, source, unnest(words) AS term FROM docs),
        terms AS (SELECT lang, term FROM seen GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
        counts AS (SELECT lang, source, term, count(*) AS n FROM seen SEMI JOIN terms USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        vocabulary AS (SELECT lang, count(*) AS v FROM terms GROUP BY lang),
        source_sums AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
        lang_counts AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
        lang_sums AS (SELECT lang, sum(n) AS total FROM lang_counts GROUP BY lang),
        p AS (
            SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v) AS p
            FROM groups g JOIN terms t USING (lang) JOIN vocabulary v USING (lang)
            LEFT JOIN source_sums s USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
        ),
        q AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS q
            FROM lang_counts JOIN lang_sums USING (lang) JOIN vocabulary USING (lang)
        ),
        apart AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ),
        pairs AS (
            SELECT g.lang, g.source, h.source AS item, coalesce(x.value, 0) AS value
            FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
            LEFT JOIN apart x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
        ),
        typical AS (
            SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value
            FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        ),
        ranked AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL SELECT lang, source, 'term', item, value FROM typical
        )
        SELECT lang, source, part, item, value::BIGINT AS value,
               row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
        FROM ranked QUALIFY part = 'pair' OR rank <= 10
    """,
    "op13_url_filter": rf"""
        WITH RECURSIVE rules(action, host, path) AS (VALUES {", ".join(map(str, RULES))}),
        pages_in AS (
            SELECT page_id, url, html, instr(url, '://') AS pos,
                   CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ),
        tags AS (
            SELECT url, unnest(regexp_extract_all(html, '{url_rules.LINK_TAG}')) AS tag, '{url_rules.IS_CANONICAL.replace("'", "''")}' AS kind, '{url_rules.HREF.replace("'", "''")}' AS pattern FROM pages_in
            UNION ALL SELECT url, unnest(regexp_extract_all(html, '{url_rules.META_TAG}')), '{url_rules.IS_REFRESH.replace("'", "''")}', '{url_rules.CONTENT.replace("'", "''")}' FROM pages_in
        ),
        told AS (
            SELECT url, kind, regexp_extract(tag, pattern, 1) || regexp_extract(tag, pattern, 2) || regexp_extract(tag, pattern, 3) AS value
            FROM tags WHERE regexp_matches(tag, kind)
        ),
        pointed AS (
            SELECT url, substr(url, 1, instr(url, '://') - 1) AS scheme, substr(url, instr(url, '://') + 3) AS rest,
                   replace(trim(CASE WHEN kind LIKE '%refresh%' THEN regexp_extract(value, '{url_rules.TARGET.replace("'", "''")}', 1) ELSE value END), '&amp;', '&') AS t
            FROM told WHERE instr(url, '://') > 0
        ),
        parted AS (
            SELECT *, scheme || '://' || regexp_extract(rest, '^[^/?#]*') AS origin, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM pointed
        ),
        ends AS (
            SELECT url AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
                WHEN regexp_matches(t, '^([A-Za-z][A-Za-z0-9+.-]*:|#|$)') THEN NULL
                WHEN starts_with(t, '//') THEN scheme || ':' || t
                WHEN starts_with(t, '/') THEN origin || t
                WHEN starts_with(t, '?') THEN origin || path || t
                ELSE origin || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^.*/') END || t END AS b
            FROM parted
        ),
        links AS (SELECT a, b FROM ends WHERE instr(b, '://') > 0 UNION SELECT b, a FROM ends WHERE instr(b, '://') > 0),
        urls AS (SELECT url AS u FROM pages_in UNION SELECT a FROM links),
        parts AS (
            SELECT u, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
                   CASE WHEN pos > 0 THEN translate(substr(u, 1, pos + 2), '{UPPER}', '{LOWER}') || translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') || regexp_extract(r, '^[^/?#]*([^#]*)', 1) END AS address
            FROM (SELECT u, instr(u, '://') AS pos, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS r FROM urls)
        ),
        judged AS (
            SELECT p.u, p.host, p.path, p.address, r.host || r.path AS rule, r.action
            FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
            QUALIFY row_number() OVER (PARTITION BY p.u ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1
        ),
        steps AS (SELECT DISTINCT x.address AS a, y.address AS b FROM links JOIN judged x ON x.u = links.a JOIN judged y ON y.u = links.b WHERE x.address <> y.address),
        reached(address) AS (
            SELECT address FROM judged WHERE action = 'block' AND address IN (SELECT a FROM steps)
            UNION SELECT b FROM reached JOIN steps ON a = address
        )
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
               coalesce(action, CASE WHEN address IN (SELECT address FROM reached) THEN 'block' ELSE 'allow' END) AS verdict,
               rule IS NULL AND coalesce(address IN (SELECT address FROM reached), false) AS aliased
        FROM pages_in JOIN judged ON judged.u IS NOT DISTINCT FROM pages_in.url
    """,
}
