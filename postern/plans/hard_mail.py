"""Queries over mail with the hard parts of the syntax: folded and repeated headers, encoded words, split and
extended parameters, nested and unclosed multiparts, quoted-printable, CRLF, missing line ends, unnamed parts.

One message per customer. The text of a message and what is in it are SQL expressions of the customer's number
that Spark and DuckDB both take; the oracles never parse mail. Outputs are compared byte by byte (SHA-256).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import messages, slim
from ..operators.rules import Options, Rules
from . import slim as slim_plan

K, NL, Q = "c_custkey", "chr(10)", "chr(39)"


def _case(by: int, *values: str) -> str:
    return f"CASE {K} % {by} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


SUBJECT = _case(
    6,
    f"'Re:' || {NL} || ' =?utf-8?B?R3LDvG4=?='",
    f"'=?utf-8?Q?Gr=C3=BCn_' || {K} || '?='",
    f"'=?utf-8?B?R3LDvG4=?= =?iso-8859-1?Q?=E9' || {K} || '?='",
    f"'=?gb2312?B?1tDOxA==?= ' || {K}",
    f"'one' || {NL} || 'Subject: two'",
    f"'plain =?utf-8?X?' || {K} || '?='",
)
SUBJECT_MEANS = _case(6, "'Re: Grün'", f"'Grün ' || {K}", f"'Grüné' || {K}", f"'中文 ' || {K}", "'one'", f"'plain =?utf-8?X?' || {K} || '?='")
TYPE = _case(5, "'application/octet-stream'", "'application/octet-stream'", "'image/svg+xml'", "'application/x-y'", "'message/rfc822'")
NAME = _case(5, f"'é-' || {K} || '.bin'", f"'a-' || {K} || '.bin'", "NULL", f"'q;' || {K} || '.bin'", "NULL")
STORED_NAME = f"coalesce({NAME}, CASE {K} % 5 WHEN 2 THEN 'unnamed.svg' ELSE 'forwarded.eml' END)"
PARAMETERS = _case(
    5,
    f"{NL} || 'Content-Disposition: attachment; filename*=utf-8' || {Q} || {Q} || '%C3%A9-' || {K} || '.bin'",
    f"{NL} || 'Content-Disposition: attachment;' || {NL} || ' filename*1=\"' || {K} || '.bin\"; filename*0=\"a-\"'",
    f"{NL} || 'content-disposition : ATTACHMENT'",
    f"'; name=\"q;' || {K} || '.bin\"'",
    f"{NL} || 'Content-Disposition: attachment'",
)
BASE64 = f"{K} % 2 = 0"
CRLF = f"{K} % 4 = 0"
CLOSED = f"{K} % 7 <> 0"
COPIES = f"(1 + {K} % 500)"
BODY = f"CASE WHEN {BASE64} THEN repeat('QUJD', {COPIES}) ELSE 'x=3D' || {K} || '=' || {NL} || {K} END"
CONTENT = f"CASE WHEN {BASE64} THEN repeat('ABC', {COPIES}) ELSE 'x=' || {K} || {K} END"
BEFORE = (
    f"'From h@xxx Thu Jan 01 00:00:00 +0000 2020' || {NL} || 'From: x@hard.example.com' || {NL} || 'Subject: ' || {SUBJECT} || {NL}"
    f" || 'Content-Type: multipart/mixed;' || {NL} || ' boundary=\"o ' || {K} || '\"' || {NL} || {NL} || 'before' || {NL} || '--o ' || {K} || {NL}"
    f" || 'Content-Type: multipart/alternative; boundary=i' || {NL} || {NL} || '--i' || {NL} || {NL} || 'text' || {NL} || '--i--' || {NL}"
    f" || '--o ' || {K} || {NL}"
)
PART = (
    f"'Content-Type: ' || {TYPE} || {PARAMETERS} || {NL} || 'Content-Transfer-Encoding: '"
    f" || CASE WHEN {BASE64} THEN 'base64' ELSE 'quoted-printable' END || {NL} || {NL} || {BODY}"
)
AFTER = f"{NL} || CASE WHEN {CLOSED} THEN '--o ' || {K} || '--' ELSE '--o' END || CASE WHEN {K} % 3 = 0 THEN '' ELSE {NL} END"


def _lines(text: str) -> str:
    return f"CASE WHEN {CRLF} THEN replace({text}, {NL}, chr(13) || {NL}) ELSE {text} END"


def hard_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(K)
    rows = rows.select(F.lit("hard").alias("path"), F.col(K).cast("long").alias("offset"), F.expr(_lines(f"{BEFORE} || {PART} || {AFTER}")).alias("text"))
    raw = F.encode("text", "utf-8")
    return rows.select("path", "offset", F.octet_length(raw).cast("long").alias("length"), raw.alias("raw"))


EST = f"CASE WHEN {BASE64} THEN 3 * {COPIES} ELSE strlen({_lines(BODY)}) END"
FOUND = f"""
a AS (
  SELECT {K}, CAST({K} AS BIGINT) AS k, {CONTENT} AS content, CAST({EST} AS BIGINT) AS est, {STORED_NAME} AS name, {TYPE} AS type
  FROM customer WHERE {CLOSED} AND {EST} >= {{least}}
), h AS (
  SELECT *, sha256(content) AS sha256 FROM a
), att AS (
  SELECT *, k = min(k) OVER (PARTITION BY sha256) AS is_first, substr(sha256, 1, 16) || '_' || arg_min(name, k) OVER (PARTITION BY sha256) AS stored_as FROM h
)"""
# The line breaks of a placeholder are those of its message.
PLACEHOLDER = f"""'Content-Type: text/plain; charset=utf-8' || {NL} || 'Content-Transfer-Encoding: 8bit' || {NL} || 'Content-Disposition: inline' || {NL}
  || 'X-Postern-Stripped: ' || type || {NL} || {NL} || '[Attachment removed by postern: "' || name || '" (' || type || ', '
  || CASE WHEN est < 1024 THEN est || ' B' ELSE printf('%.1f KB', est / 1024.0::DOUBLE) END || '), saved as ' || stored_as || ']'"""


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages.analyze(hard_mail(spark, sf_dir))
    return rows.select(
        F.col("offset").alias("k"), "subject", F.col("att_count").cast("long").alias("att"), "att_bytes", F.array_join("att_names", "|").alias("names")
    )


def _extracted(least_kb: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = slim.extract(hard_mail(spark, sf_dir), Options(extract=True, min_attachment_kb=least_kb))
        return found.select(F.col("offset").alias("k"), "name", "bytes", "sha256", "stored_as", "is_first")

    return run


def _stripped(least_kb: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        opts = Options(strip=True, extract=True, min_attachment_kb=least_kb)
        out = slim_plan.plan(hard_mail(spark, sf_dir), Rules(), opts).out
        return out.select(F.col("offset").alias("k"), F.sha2("out_raw", 256).alias("sha256"), F.col("stripped").cast("long").alias("stripped"))

    return run


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = hard_mail(spark, sf_dir)
    p = slim_plan.plan(mail, Rules(), Options(extract=True))
    return slim_plan.index_rows(p.extracted, p.classified)


def _extract_sql(least: int) -> str:
    return f"WITH {FOUND.format(least=least)} SELECT k, name, CAST(strlen(content) AS BIGINT) AS bytes, sha256, stored_as, is_first FROM att"


def _strip_sql(least: int) -> str:
    after = f"CASE WHEN att.k IS NULL THEN {PART} ELSE {PLACEHOLDER} END".replace(K, f"customer.{K}")
    text = f"{BEFORE} || {after} || {AFTER}".replace(f"customer.{K}", K).replace(K, f"customer.{K}")
    whole = f"CASE WHEN {CRLF} THEN replace(text, {NL}, chr(13) || {NL}) ELSE text END"
    return f"""WITH {FOUND.format(least=least)}, t AS (
      SELECT customer.{K}, att.k IS NOT NULL AS cut, {text} AS text FROM customer LEFT JOIN att ON att.k = customer.{K})
    SELECT CAST({K} AS BIGINT) AS k, sha256({whole}) AS sha256, CAST(cut AS BIGINT) AS stripped FROM t"""


QUERIES = {
    "hard_headers": _headers,
    "hard_extract": _extracted(0),
    "hard_extract_from_1_kb": _extracted(1),
    "hard_strip": _stripped(0),
    "hard_strip_from_1_kb": _stripped(1),
    "hard_index": _index,
}
ORACLES = {
    "hard_headers": f"""SELECT CAST({K} AS BIGINT) AS k, {SUBJECT_MEANS} AS subject, CAST({CLOSED} AS BIGINT) AS att,
      CAST(CASE WHEN {CLOSED} THEN {EST} ELSE 0 END AS BIGINT) AS att_bytes, CASE WHEN {CLOSED} THEN coalesce({NAME}, '') ELSE '' END AS names FROM customer""",
    "hard_extract": _extract_sql(0),
    "hard_extract_from_1_kb": _extract_sql(1024),
    "hard_strip": _strip_sql(0),
    "hard_strip_from_1_kb": _strip_sql(1024),
    "hard_index": f"""WITH {FOUND.format(least=0)} SELECT stored_as, name AS original_name, printf('%.3f', strlen(content) / 1048576.0::DOUBLE) AS size_mb,
      CASE WHEN is_first THEN 'yes' ELSE 'duplicate' END AS first_seen, 'x@hard.example.com' AS "from", '' AS date, {SUBJECT_MEANS} AS subject FROM att""",
}
