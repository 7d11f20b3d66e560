"""One query per operator over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, html_extract, mixing, ngram_join, packing, quality_rules, token_counts, token_output, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    out = quality_rules.apply_policy(quality_rules.ledger(docs), "v1")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", "base_failed", "kept"
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents", "doc_id", "text"), keep="max")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    got = chat_format.read_back(chat_format.examples(convs.union(extra)))
    return got.select(
        "conv_id",
        "n_turns",
        F.sha2("turns_text", 256).alias("turns_sha256"),
        "loss_chars",
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return ngram_join.joined(docs, n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url")
    # A page's outcome is the label of the document that its path names (/en/7817): bad if toxic or of no quality.
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull(), 0)
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    _, path = url_filters.split_url(F.col("url"))
    number = F.regexp_extract(path, r"/([0-9]+)(?:\.[A-Za-z]+)?/?$", 1).try_cast("bigint")
    outcomes = pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").groupBy("page_id").agg(F.max("bad").alias("bad"))
    out = url_filters.judged(pages, outcomes)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    folder, manifest = token_output.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"))
    return token_output.read_shards(folder, manifest)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_rules,
            op2_exact_dedup,
            op3_chat_format,
            op4_token_counts,
            op5_packing,
            op6_ngram_join,
            op7_html_extract,
            op8_url_filters,
            op9_token_output,
            op10_mixing,
        )
    }


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents
), win AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS u(i)
), twice AS (
  SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n FROM twice, unnest(range(0, 8)) AS v(o) GROUP BY r
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(regexp_extract_all(t, '\p{{Lu}}')) AS BIGINT) AS n_upper,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.r = w.r
), l AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m
), b AS (
  SELECT *, CAST(
    CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 40 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * word_chars THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN word_chars > 30 * n_words THEN 64 ELSE 0 END AS BIGINT) AS fail_bits FROM l
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
  fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""

OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""

OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, 16 + length(role) + length(text)
      + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', ''))
      + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS piece,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS is_last FROM c
), f AS (
  SELECT *, sum(piece) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS chars FROM e
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

# The posterior's probability below the threshold by quadrature (rate = sin(u)^2), not by the operator's continued fraction.
_UP = "CASE WHEN {0} > 0 THEN greatest(2, 1 / least(0.999, greatest(0.001, ({1}) / {0})) - 1) ELSE 2 END"
OP8_SQL = rf"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM cut
), docs AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY 1
), seen AS (
  SELECT page_id, max(bad) AS bad FROM p JOIN docs ON doc_id = try_cast(regexp_extract(path, '/([0-9]+)(?:\.[A-Za-z]+)?/?$', 1) AS BIGINT)
  WHERE bad IS NOT NULL GROUP BY 1
), counts AS (
  SELECT host, coalesce(sum(bad), 0) AS bad, count(bad) AS n FROM (SELECT DISTINCT p.host, page_id, bad FROM p LEFT JOIN seen USING (page_id)) GROUP BY 1
), named AS (
  SELECT *, split_part(split_part(host, '@', -1), ':', 1) AS name FROM counts
), parted AS (
  SELECT *, string_split(name, '.') AS l, regexp_full_match(name, '[0-9.]+') AS num,
    array_to_string(string_split(name, '.')[-2:], '.') IN ({", ".join(f"'{x}'" for x in url_filters.SUFFIXES)}) AS two FROM named
), h AS (
  SELECT host, bad, n, CASE WHEN num THEN name WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
    CASE WHEN num THEN '' WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM parted
), f AS (
  SELECT *, sum(bad) OVER d AS db, sum(n) OVER d AS dn, sum(bad) OVER s AS sb, sum(n) OVER s AS sn, sum(bad) OVER () AS tb, sum(n) OVER () AS tn,
    row_number() OVER (PARTITION BY domain ORDER BY host) AS di, row_number() OVER (PARTITION BY suffix ORDER BY host) AS si
  FROM h WINDOW d AS (PARTITION BY domain), s AS (PARTITION BY suffix)
), scatter AS (
  SELECT 1 AS level, bad, n, (db - bad + 0.5) / (dn - n + 1.0) AS q FROM f WHERE dn > n
  UNION ALL SELECT 2, db, dn, (sb - db + 0.5) / (sn - dn + 1.0) FROM f WHERE di = 1 AND sn > dn
  UNION ALL SELECT 3, sb, sn, (tb - sb + 0.5) / (tn - sn + 1.0) FROM f WHERE si = 1 AND tn > sn
), fit AS (
  SELECT level, sum((n - 1) * q * (1 - q)) AS room, sum(n * (bad / n - q) * (bad / n - q)) - sum(q * (1 - q)) AS over
  FROM scatter WHERE n > 0 GROUP BY 1
), k AS (
  SELECT coalesce(max(k) FILTER (level = 1), 2) AS k1, coalesce(max(k) FILTER (level = 2), 2) AS k2, coalesce(max(k) FILTER (level = 3), 2) AS k3
  FROM (SELECT level, {_UP.format("room", "over")} AS k FROM fit)
), t1 AS (
  SELECT f.*, k1, k2, k3, bad * (k1 + 1.0) / (k1 + n) AS hb, n * (k1 + 1.0) / (k1 + n) AS hn FROM f, k
), t2 AS (
  SELECT *, sum(hb) OVER d AS kdb, sum(hn) OVER d AS kdn FROM t1 WINDOW d AS (PARTITION BY domain)
), t3 AS (
  SELECT *, kdb * (k2 + 1.0) / (k2 + kdn) AS ob, kdn * (k2 + 1.0) / (k2 + kdn) AS onn FROM t2
), t4 AS (
  SELECT *, sum(ob) FILTER (di = 1) OVER s AS ksb, sum(onn) FILTER (di = 1) OVER s AS ksn FROM t3 WINDOW s AS (PARTITION BY suffix)
), t5 AS (
  SELECT *, ksb * (k3 + 1.0) / (k3 + ksn) AS pb, ksn * (k3 + 1.0) / (k3 + ksn) AS pn FROM t4
), c0 AS (
  SELECT *, sum(pb) FILTER (si = 1) OVER () - pb + 0.5 AS x0, sum(pn) FILTER (si = 1) OVER () - pn + 1.0 AS y0 FROM t5
), c1 AS (
  SELECT *, x0 / y0 * least(k3, y0) + ksb - ob AS x1, least(k3, y0) + ksn - onn AS y1 FROM c0
), c2 AS (
  SELECT *, x1 / y1 * least(k2, y1) + kdb - hb AS x2, least(k2, y1) + kdn - hn AS y2 FROM c1
), c3 AS (
  SELECT *, x2 / y2 AS p2, least(k1, y2) AS w2 FROM c2
), post AS (
  SELECT host, p2 * w2 + bad AS a, (1 - p2) * w2 + n - bad AS b FROM c3
), mass AS (
  SELECT host, u, (2 * a - 1) * ln(sin(u)) + (2 * b - 1) * ln(cos(u)) AS m, max(m) OVER (PARTITION BY host) AS top
  FROM post, (SELECT (i + 0.5) * pi() / 4000 AS u FROM range(2000) r(i))
), tail AS (
  SELECT host, sum(exp(m - top)) FILTER (sin(u) * sin(u) <= {url_filters.THRESHOLD}) / sum(exp(m - top)) AS below FROM mass GROUP BY 1
), rules AS (
  SELECT * FROM (VALUES {", ".join(f"('{r}', '{v}')" for r, v in url_filters.RULES)}) t(rule, says)
), fitting AS (
  SELECT DISTINCT host, path, rule, says FROM p JOIN rules
    ON ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, instr(rule, '/')))
), best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM fitting GROUP BY ALL
)
SELECT page_id, p.host, p.path, rule, coalesce(says, CASE WHEN below < {url_filters.DOUBT} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON best.host = p.host AND best.path = p.path LEFT JOIN tail ON tail.host = p.host
"""

OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
l AS (SELECT *, 3 * source_size / weight AS level FROM w),
b AS (
  SELECT *, coalesce(sum(source_size) OVER p, 0) AS size_below, coalesce(sum(weight) OVER p, 0) AS weight_below,
    sum(source_size) OVER () AS size_all, sum(weight) OVER () AS weight_all
  FROM l WINDOW p AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (SELECT *, CAST(size_all - 3 * size_below AS DOUBLE) / (weight_all - weight_below) AS own FROM b),
f AS (SELECT *, max(CASE WHEN own <= level THEN own END) OVER () AS final_level FROM o),
t AS (SELECT source, source_size, coalesce(least(3 * CAST(source_size AS DOUBLE), final_level * weight), 0) AS target FROM f),
r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS rank,
    CAST(('0x' || substr(md5(coalesce('7:' || d.source, '7')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(least(floor(rate * (rank + 1) + u) - floor(rate * rank + u), ceil(rate)) AS BIGINT) AS copies FROM r
)
SELECT doc_id, source, size, source_size, target, copies, CAST(copies * size AS BIGINT) AS taken FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1_SQL,
        "op2_exact_dedup": OP2_SQL,
        "op3_chat_format": OP3_SQL,
        "op8_url_filters": OP8_SQL,
        "op10_mixing": OP10_SQL,
    }
