"""The thin queries over the operators of this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(_table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """The crawl's log: page p was fetched on day p mod 365 of 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")).alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries over the hosts of the crawl, dealt by a checksum of the host: a quarter are blocked,
    freed and blocked again, a quarter have one directory blocked; two parent domains come and go."""
    from .url_filters import host_of

    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    n = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), k)
    entry = lambda pattern, category, action, at: F.struct(pattern.alias("pattern"), F.lit(category).alias("category"), F.lit(action).alias("action"), at.alias("at"))
    host, folder = F.col("host"), F.concat(F.col("host"), F.lit("/en"))
    own = (
        F.when(n % 4 == 0, F.array(entry(host, "malware", "add", day(n % 100)), entry(host, "malware", "remove", day(n % 100 + 60)), entry(host, "malware", "add", day(n % 100 + 150))))
        .when(n % 4 == 1, F.array(entry(folder, "spam", "add", day(n % 300))))
        .otherwise(F.array())
    )
    few = pages.sparkSession.sql("SELECT 'example.net' AS pattern, 'adult' AS category, a AS action, d AS at FROM VALUES ('add', DATE'2024-03-01'), ('remove', DATE'2024-09-01') AS t(a, d)")
    return hosts.select(F.inline(own)).union(few)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import url_filter

    pages = _table(spark, sf_dir, "pages")
    return url_filter(captures(pages), list_entries(pages))


OP2_SQL = r"""
WITH c AS (SELECT page_id, url, (DATE '2024-01-01' + (page_id % 365)::INT)::DATE AS fetched,
  rtrim(lower(regexp_extract(coalesce(url, ''), '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
  regexp_extract(coalesce(url, ''), '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 4))::INT AS n FROM c WHERE host <> ''),
i AS (SELECT host AS pattern, 'malware' AS category, DATE '2024-01-01' + n % 100 AS since, DATE '2024-01-01' + (n % 100 + 60) AS until FROM h WHERE n % 4 = 0
  UNION ALL SELECT host, 'malware', DATE '2024-01-01' + (n % 100 + 150), NULL FROM h WHERE n % 4 = 0
  UNION ALL SELECT host || '/en', 'spam', DATE '2024-01-01' + n % 300, NULL FROM h WHERE n % 4 = 1
  UNION ALL SELECT 'example.net', 'adult', DATE '2024-03-01', DATE '2024-09-01'),
m AS (SELECT c.page_id, c.url, i.category FROM c JOIN i ON (host = pattern OR ends_with(host, '.' || pattern) OR starts_with(host || path || '/', pattern || '/'))
  AND since <= fetched AND (until IS NULL OR fetched < until)),
g AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS cats FROM m GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched, coalesce(n, 0)::BIGINT AS n_entries, coalesce(cats, '') AS categories, n IS NOT NULL AS blocked FROM c LEFT JOIN g USING (page_id)
"""


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_shards import materialise, read_back

    return read_back(*materialise(_table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import ledger, verdicts

    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"]
    return verdicts(ledger(_table(spark, sf_dir, "documents"))).select(*cols)


OP3_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
e AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT rid, pos, word, string_agg(word, ' ') OVER win AS gram, count(*) OVER win AS k FROM e
      WINDOW win AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
again AS (SELECT rid, pos, gram, count(*) OVER (PARTITION BY rid, gram) AS c FROM g WHERE k = 5),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(pos, pos + 5)) AS p FROM again WHERE c >= 2) GROUP BY rid),
ls AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS l FROM t),
m AS (SELECT t.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
  coalesce(cov.n, 0) AS n_repeat_words
  FROM t JOIN w USING (rid) JOIN ls USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > 3 * word_chars)::INT
  + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 40 * n_words)::INT AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 47) = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM b
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import by_position, curriculum

    placed = by_position(curriculum(_table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "source_size", "target", "taken", F.col("passes").cast("long").alias("passes"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('7:' || doc_id), 1, 15))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
r AS (SELECT *, ((sid - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM r
  WINDOW b AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, sid, source_size, CASE WHEN cap / weight < level THEN cap ELSE least(cap, max(level) OVER () * weight) END AS target FROM l),
c AS (SELECT d.*, t.sid, t.source_size, t.target, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole,
  sum(size) OVER (PARTITION BY t.sid ORDER BY u % ((SELECT count(*) FROM d) // 4096 + 1), u, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CASE WHEN whole < 3 THEN greatest(0, least(size, floor(target - whole * source_size + 0.5) - before)) ELSE 0 END AS extra FROM c)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (whole * size + extra)::BIGINT AS taken, (whole + (extra > 0)::INT)::BIGINT AS passes FROM x
"""


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), run_words=51)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return mine(vectors, F.col("vec_id") % 100 == 0)


OP11_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .metric_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id
  AND list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_media": op1_media,
        "op2_url_filters": op2_url_filters,
        "op3_quality_rules": op3_quality_rules,
        "op4_mixing": op4_mixing,
        "op5_html": op5_html,
        "op6_toxicity": op6_toxicity,
        "op7_bpe": op7_bpe,
        "op8_token_shards": op8_token_shards,
        "op9_jaccard": op9_jaccard,
        "op10_suffix": op10_suffix,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_whitening": op12_whitening,
        "op13_metric_join": op13_metric_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op3_quality_rules": OP3_SQL, "op4_mixing": OP4_SQL, "op11_hard_negatives": OP11_SQL, "op13_metric_join": OP13_SQL}
