import pytest
from pyspark.sql import functions as F

from postern.functions import mime, text
from postern.operators import rules
from postern.plans import queries


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_extract_addrs_equals_plain_python(spark):
    values = ['"A, B" <A@B.c>, d@e.f', "a@b@c", "<nobody> real@x.y", "mailto:q@r.s", "'x@y.z.'", "", "no address", "ÄB@c.d e@f", "a@b <c@d"]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    got = {r.v: r.a for r in rows.select("v", text.extract_addrs(F.col("v")).alias("a")).collect()}
    assert got.pop(None) == []
    assert got == {v: mime.addresses(v) for v in values}


def test_document_addresses_with_markup(spark, tmp_path):
    texts = ["Jane <jane@X.org>, too@x.org", "<b>bold</b> B@c.d and e@f.g", "a < b\n> q@r.s", "<i@j> <k@l>\n<I@J>", "plain@x.org", "none", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.address) for r in queries.document_addresses(spark, str(tmp_path)).collect()}
    assert got == {(i, a) for i, t in enumerate(texts) for a in mime.addresses(t or "")}
    assert {(0, "jane@x.org"), (1, "b@c.d"), (2, "q@r.s")} <= got


@pytest.mark.parametrize(
    ("n", "human"),
    [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1048575, "1024.0 KB"), (1 << 20, "1.0 MB"), (3 << 40, "3.0 TB"), (5 << 50, "5120.0 TB")],
)
def test_human_bytes(spark, n, human):
    assert one(spark, text.human_bytes(F.lit(n))) == human
    assert text.human_bytes_py(n) == human


def test_numbers(spark):
    assert one(spark, text.mib(F.lit(1 << 20))) == "1.000"
    assert one(spark, text.percent(F.lit(1), F.lit(8))) == "12.50"
    assert one(spark, text.percent(F.lit(1), F.lit(0))) == "100.00"
    assert one(spark, text.truncate(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.truncate(F.lit("abcd"), 4)) == "abcd"


@pytest.mark.parametrize(
    ("name", "safe"),
    [
        ("a/b:c.txt", "a_b_c.txt"),
        ("  .x. ", "x"),
        ("...", "unnamed"),
        ("", "unnamed"),
        ("n" * 120 + ".extension-long", "n" * 90 + ".extension-"),
        ("n" * 120, "n" * 90),
        ("tab\there", "tab_here"),
    ],
)
def test_sanitize(spark, name, safe):
    assert one(spark, text.sanitize(F.lit(name))) == safe


def test_csv_field(spark):
    assert [one(spark, text.csv_field(F.lit(v))) for v in ("a", "a,b", 'a"b', "a\nb")] == ["a", '"a,b"', '"a""b"', '"a\nb"']


def test_domain_suffixes(spark):
    assert one(spark, text.domain_suffixes(F.lit("a.b.c"))) == ["a.b.c", "b.c", "c"]


@pytest.mark.parametrize(
    ("pattern", "address", "hit"),
    [("bot@*", "bot@x.y", True), ("*@*.shop.com", "a@b.shop.com", True), ("*@*.shop.com", "a@shop.com", False), ("a_b*", "axb@c", False), ("a%*", "a%c", True)],
)
def test_glob(spark, pattern, address, hit):
    rows = spark.createDataFrame([(address, pattern)], "a string, p string").withColumn("l", text.glob_like(F.col("p")))
    assert rows.select(F.expr("a LIKE l").alias("x")).first().x is hit


def test_list_lines():
    assert rules.parse_list_line(" A@b.c; d.e  f@* ") == ["a@b.c", "d.e", "f@*"]
    assert rules.parse_list_line("Jo <Jo@X.y>") == ["jo@x.y"]
    assert rules.parse_list_line("mailto:q@r.s\t'z.w'") == ["q@r.s", "z.w"]
    assert rules.parse_list_line("# note") == rules.parse_list_line("  ") == []
    assert rules.parse_list_line('"a, b",3', csv=True) == ["a, b"]
    assert rules.parse_list_line("X.Y,3", csv=True) == ["x.y"]
    assert rules.parse_list("﻿Domain,messages\nA.b,3\n(unknown),1\n") == ["a.b", "(unknown)"]
    assert rules.parse_list("a.b\nc.d,e.f\n") == ["a.b", "c.d", "e.f"]


def test_match_order(spark):
    given = ["*@shop.com", "shop.com", "a@shop.com b@shop.com", "@mail.net", "com"]
    patterns = rules.compile_patterns(given)
    assert [p[1] for p in patterns] == ["*@shop.com", "shop.com", "a@shop.com", "b@shop.com", "@mail.net", "com"]
    senders = ["a@shop.com", "z@shop.com", "z@eu.shop.com", "q@mail.net", "q@notmail.net", "", "x@other.com"]
    rows = spark.createDataFrame([(s,) for s in [*senders, None]], "sender string")
    got = {r.sender: r.idx for r in rules.match(rows, rules.patterns_df(spark, patterns)).collect()}
    assert got == {"a@shop.com": 2, "z@shop.com": 1, "z@eu.shop.com": 1, "q@mail.net": 4, "x@other.com": 5}


def test_classify_precedence(spark):
    rows = [("a@x.y", ["sent", "Spam"], True), ("b@x.y", [], True), ("c@x.y", [], False), ("safe@x.y", ["SPAM"], True), (None, [], False), (None, [], True)]
    msgs = spark.createDataFrame([(i, *r, 10) for i, r in enumerate(rows)], "offset int, sender string, labels array<string>, bulk boolean, size bigint")
    rule = rules.Rules(drop=rules.compile_patterns(["x.y", "nothing.org"]), keep=rules.compile_patterns(["safe@x.y"]), labels=["spam"], bulk=True)
    out = rules.classify(msgs, rule)
    assert {r.offset: (r.reason, r.rule_idx) for r in out.collect()} == {
        0: ("label", None), 1: ("bulk", None), 2: ("sender", 0), 3: (None, None), 4: (None, None), 5: ("bulk", None)
    }
    assert [(r.pattern, r.msgs) for r in rules.rule_hits(out, rule.drop).orderBy("idx").collect()] == [("x.y", 1), ("nothing.org", 0)]
