"""Queries of the subpackage: one for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.llm import exact_dedup as exact
from indexloom.llm import alignment, line_dedup, media, mixing, ngram_join, packing, phrases, substring, suffixes, token_orc, toxicity, url_filter
from indexloom.llm.scratch import Scratch

VOCABULARY = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))["documents"].drop("_uid")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(documents(spark, sf_dir), count_links=True)["documents"].drop("_uid", "first")


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Scratch(spark).cut(media.with_media(documents(spark, sf_dir)), "media")  # compressed: every file has the same palette
    return media.features(stored)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(documents(spark, sf_dir)).drop("_uid")


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("token-orc")
    token_orc.write(documents(spark, sf_dir), path, public_tokenizers.path(VOCABULARY), end_id=2)
    return token_orc.digest(token_orc.read(spark, path))


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir)).drop("_uid")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), end_id=1)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.to_date(F.lit("2023-01-01")), (F.col("page_id") % 720).cast("int")))
    judged = url_filter.temporal_filter(captures, url_filter.sample_entries(pages))
    return judged.withColumn("day", F.col("day").cast("string")).withColumn("since", F.col("since").cast("string"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.report(phrases.collocations(documents(spark, sf_dir)))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_gif_media": op3_gif_media,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_token_orc": op5_token_orc,
        "op6_line_spread": op6_line_spread,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_best_fit": op8_best_fit,
        "op9_url_filter": op9_url_filter,
        "op10_toxicity": op10_toxicity,
        "op11_phrase_mining": op11_phrase_mining,
        "op12_token_alignment": op12_token_alignment,
        "op13_suffix_dedup": op13_suffix_dedup,
    }


#: White-space-separated words of a text, in DuckDB.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({_WORDS}) AS size, md5('17:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents
), s AS (
  SELECT source, cast(sum(size) AS double) AS source_size,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::double AS w
  FROM d GROUP BY source
), fill(level, step) AS (
  SELECT 0.0::double, 0
  UNION ALL
  SELECT (SELECT (sum(source_size) * 1.5 - coalesce(sum(2.0 * source_size) FILTER (w * level >= 2.0 * source_size), 0))
                 / sum(w) FILTER (w * level < 2.0 * source_size) FROM s), step + 1
  FROM fill WHERE step < (SELECT count(*) + 1 FROM s)
           AND (SELECT count(*) FROM s WHERE w * level < 2.0 * source_size) > 0
), t AS (
  SELECT source, source_size, least(w * (SELECT max(level) FROM fill), 2.0 * source_size) AS target FROM s
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, cast(round(t.target) AS bigint) AS goal,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, cast(size AS bigint) AS size, cast(source_size AS bigint) AS source_size, target,
       cast(CASE WHEN size = 0 THEN 0 ELSE
         (goal // cast(source_size AS bigint)) * size
         + greatest(0, least(start + size, goal % cast(source_size AS bigint)) - start) END AS bigint) AS taken
FROM p
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT a AS x, a AS y FROM both_ways
  UNION
  SELECT x, b FROM reach JOIN both_ways ON y = a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(l.n_links, 0) AS n_links
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a) l ON l.a = d.doc_id LEFT JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM v) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM again CROSS JOIN (SELECT unnest(range(0, 20)) AS j)
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
"""

OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), b AS (
  SELECT doc_id, source, line, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l
), boiler AS (
  SELECT bare FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce(source, chr(1))) >= 8
), k AS (
  SELECT b.doc_id, count(*) AS n_lines, count(boiler.bare) AS n_removed,
         string_agg(b.line, chr(10) ORDER BY pos) FILTER (boiler.bare IS NULL) AS kept
  FROM b LEFT JOIN boiler ON b.bare = boiler.bare GROUP BY b.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP9_SQL = r"""
WITH p AS (
  SELECT page_id, date '2023-01-01' + cast(page_id % 720 AS integer) AS day,
         regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '\.+$', '') AS host
  FROM pages
), h AS (SELECT DISTINCT host, string_split(host, '.') AS names FROM p WHERE host <> ''
), k AS (
  SELECT key, length(key) * 37 + ascii(key) * 11 + coalesce(ascii(substr(key, 4, 1)), 0) * 17 AS n, key LIKE '%adult%' AS adult
  FROM (SELECT CASE WHEN len(names) > 3 THEN array_to_string(names[2:], '.') ELSE host END AS key FROM h
        UNION SELECT host FROM h WHERE host LIKE '%adult%')
), iv AS (
  SELECT key, CASE WHEN adult THEN 'adult' ELSE 'spam' END AS category, date '2023-01-01' + cast(n % 300 AS integer) AS since,
         CASE WHEN NOT adult AND n % 4 <> 0 THEN date '2023-01-01' + cast(n % 300 + 60 + n % 180 AS integer) END AS until
  FROM k WHERE adult OR n % 3 = 0
  UNION ALL
  SELECT key, 'spam', date '2023-01-01' + cast(n % 300 + 400 AS integer), NULL FROM k WHERE NOT adult AND n % 3 = 0 AND n % 2 = 1 AND n % 4 <> 0
), m AS (
  SELECT p.page_id, iv.key, iv.category, iv.since,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(iv.key) DESC, iv.since, iv.category) AS r
  FROM p JOIN iv ON (p.host = iv.key OR p.host LIKE '%.' || iv.key) AND iv.since <= p.day AND (iv.until IS NULL OR p.day < iv.until)
)
SELECT p.page_id, p.host, cast(p.day AS varchar) AS day, m.key IS NOT NULL AS blocked, m.category, m.key AS list_key, cast(m.since AS varchar) AS since
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.r = 1
"""


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS (
  SELECT lang, w[i:i + k - 1] AS g, k AS size, count(*) AS f FROM s JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) ON i + k - 1 <= len(w)
  GROUP BY ALL HAVING count(*) >= 100
), held AS (
  SELECT lang, g[1:size - 1] AS g, f FROM g WHERE size > 2 UNION SELECT lang, g[2:size] AS g, f FROM g WHERE size > 2
), c AS (SELECT lang, g, size, f AS a FROM g ANTI JOIN held USING (lang, g, f) WHERE size > 1
), cuts AS (
  SELECT c.lang, c.g, c.a, x.f AS l, y.f AS r, n.n, x.size AS k,
         cast((1000::hugeint * c.a * n.n) // (x.f::hugeint * y.f) AS bigint) AS score
  FROM c JOIN g x ON x.lang = c.lang AND x.size < c.size AND x.g = c.g[1:x.size]
         JOIN g y ON y.lang = c.lang AND y.size = c.size - x.size AND y.g = c.g[x.size + 1:c.size] JOIN n ON n.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM best
)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, cast(n AS bigint) AS n, score FROM ranked
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY rank <= 2000
"""


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), v AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM v) WHERE k > 1
), begun AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM begun) GROUP BY doc_id, s
), pieces AS (
  SELECT s.doc_id, s.b AS a, coalesce(lead(s.a) OVER (PARTITION BY s.doc_id ORDER BY s.a), d.n) AS b FROM spans s JOIN d ON d.doc_id = s.doc_id
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id
), kept AS (
  SELECT p.doc_id, string_agg(substr(d.h, 2 * p.a + 1, 2 * (p.b - p.a)), '' ORDER BY p.a) AS h FROM pieces p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id
), gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, cast(coalesce(g.n, 0) AS bigint) AS n_removed, coalesce(g.spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN gone g ON g.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_ngram_jaccard": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op6_line_spread": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op9_url_filter": OP9_SQL, "op11_phrase_mining": OP11_SQL, "op13_suffix_dedup": OP13_SQL}
