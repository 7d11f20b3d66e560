import io
import os

import pytest

from postern import __main__ as cli
from postern.operators import messages, reports, rules, slim
from postern.plans import slim as slim_plan
from postern.plans import stats as stats_plan
from postern.sinks import files
from postern.sources import mbox

FROM = "From u@xxx Thu Jan 01 00:00:00 +0000 2020\n"


def message(sender="a@b.c", *headers, body="hello\n", attach=()):
    lines = [f"From: {sender}", *headers]
    if attach:
        parts = "".join(
            f'--B\nContent-Type: image/png; name="{name}"\nContent-Transfer-Encoding: base64\n\n{data}\n' for name, data in attach
        )
        return FROM + "\n".join([*lines, "Content-Type: multipart/mixed; boundary=B", "", "--B", "", body.rstrip("\n")]) + f"\n{parts}--B--\n\n"
    return FROM + "\n".join([*lines, "", body]) + "\n"


ARCHIVE = "".join(
    [
        message("A <a@x.org>", "To: me@own.net", "X-Gmail-Labels: Inbox", attach=[("p.png", "QUFB"), ("q.png", "QUFB")]),
        message("me@own.net", "To: a@x.org, b@y.org", "Cc: c@y.org", "X-Gmail-Labels: Sent"),
        message("news@shop.com", "List-Id: n", "X-Gmail-Labels: Inbox,Spam"),
        message("b@y.org", body="From here on\n\nFrom this line too\n"),
        message("z@w.org", "Content-Length: 99", attach=[("p.png", "QkJC")]).rstrip("\n"),
    ]
).encode()


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "all.mbox"
    path.write_bytes(ARCHIVE)
    return str(path)


@pytest.mark.parametrize(
    ("line", "blank", "expected"),
    [
        (b"From a@b Thu Jan 01 00:00:00 2020\r", False, True),
        (b"From a@b Thu Jan 01 00:00:00", True, True),
        (b"From a@b Thu Jan 01 00:00:00", False, False),
        (b"From  a 00:00 2020", True, False),
        (b"From now on: 2020", False, True),
        (b"From here on 2020", True, False),
        (b"From ", True, False),
        (b">From a 00:00 2020", True, False),
    ],
)
def test_separator(line, blank, expected):
    assert mbox.is_separator(line, blank) is expected


@pytest.mark.parametrize("raw", [ARCHIVE, ARCHIVE.replace(b"\n", b"\r\n"), b"\n" + ARCHIVE, b"before\n\n" + ARCHIVE, FROM.encode() * 3, b"x"])
def test_any_split_gives_the_same_ranges(raw):
    whole = list(mbox.ranges(raw, 0, len(raw)))
    assert sum(n for _, n in whole) == len(raw) and whole[0][0] == 0
    assert [a + n for a, n in whole[:-1]] == [a for a, _ in whole[1:]]
    for size in range(1, 90):
        got = [r for at in range(0, len(raw), size) for r in mbox.ranges(raw, at, min(len(raw), at + size))]
        assert got == whole, size


def test_leading_newline_does_not_split():
    assert len(list(mbox.ranges(b"\n" + FROM.encode(), 0, 1000))) == 1
    assert len(list(mbox.ranges(ARCHIVE, 0, len(ARCHIVE)))) == 5


def test_source(spark, archive, tmp_path):
    for size in (100, 1 << 20):
        rows = mbox.read(spark, archive, split_bytes=size).orderBy("offset").collect()
        assert b"".join(bytes(r.raw) for r in rows) == ARCHIVE and len(rows) == 5
    assert mbox.read(spark, archive, include_raw=False).where("raw IS NULL").count() == 5
    (tmp_path / "empty.mbox").write_bytes(b"")
    with pytest.raises(Exception, match="is empty"):
        mbox.read(spark, str(tmp_path / "empty.mbox")).count()
    with pytest.raises(Exception, match="cannot open"):
        mbox.read(spark, str(tmp_path / "none.mbox")).count()


def test_roundtrip_and_newline_repair(spark, archive, tmp_path):
    out = str(tmp_path / "copy.mbox")
    assert files.write_mbox(mbox.read(spark, archive, split_bytes=64), out) == len(ARCHIVE)
    with open(out, "rb") as f:
        assert f.read() == ARCHIVE
    rows = spark.createDataFrame([("f", i, bytearray(raw)) for i, raw in enumerate([b"a", b"", b"b\n", b"c"])], "path string, offset bigint, raw binary")
    files.write_mbox(rows, out)
    with open(out, "rb") as f:
        assert f.read() == b"a\nb\nc"


def test_reports(spark, archive):
    msgs = messages.analyze(mbox.read(spark, archive))
    t = reports.totals(msgs).first()
    assert (t.messages, t.sent_messages, t.bulk_messages, t.attachments, t.attachment_bytes) == (5, 1, 1, 3, 9)
    assert t.bytes == len(ARCHIVE) and t.unique_people_you_wrote_to == 2 and t.has_labels
    rep = {(r.dim, r.key): r.msgs for r in reports.reports(msgs).collect()}
    assert rep["sent_to_domains", "y.org"] == 1 and rep["labels", "Spam"] == 1 and rep["received_to", "me@own.net"] == 1
    assert sum(r.bytes for r in reports.report(msgs, "received_senders").collect()) == t.received_bytes
    assert reports.detected_me(msgs).first().sender == "me@own.net"
    assert reports.totals(msgs, me=[" B@y.org "]).first().sent_messages == 1
    top = reports.largest(msgs, 2).collect()
    assert [r["from"] for r in top][0] == "a@x.org" and top[0].att_names == "p.png; q.png"
    assert reports.detected_me(msgs.where("false")).count() == 0


def test_unparseable_message_is_counted(monkeypatch):
    monkeypatch.setattr(messages.mime, "headers", lambda *_: 1 / 0)
    assert messages.fields(b"From: a@b\n\n", True)["subject"] == messages.UNPARSEABLE


def test_slim(spark, archive, tmp_path):
    rule = rules.Rules(drop=rules.compile_patterns(["y.org", "none.org"]), bulk=True)
    opts = rules.Options(strip=True, extract=True)
    run = slim_plan.SlimOptions(
        str(tmp_path / "kept.mbox"), str(tmp_path / "dropped.mbox"), str(tmp_path / "dropped.csv"), str(tmp_path / "att"), False, rule, opts
    )
    lines = list(slim_plan.run(spark, archive, run))
    assert any("2 attachments" not in line and "3 attachments" in line for line in lines) and "  none.org" in lines
    kept = (tmp_path / "kept.mbox").read_bytes()
    assert kept.count(b"X-Postern-Stripped: image/png") == 3 and b"Content-Length" not in kept and b"QUFB" not in kept
    assert sorted(p.name[16:] for p in (tmp_path / "att").iterdir() if p.suffix == ".png") == ["_p.png", "_p.png"]
    index = (tmp_path / "att" / "attachments_index.csv").read_text("utf-8-sig").splitlines()
    assert index[0].startswith("stored_as,") and [line.split(",")[3] for line in index[1:]] == ["yes", "duplicate", "yes"]
    table = (tmp_path / "dropped.csv").read_text("utf-8-sig").splitlines()
    assert [line.split(",")[:2] for line in table[1:]] == [["bulk", ""], ["sender", "y.org"]]
    dropped = (tmp_path / "dropped.mbox").read_bytes()
    assert len(list(mbox.ranges(dropped, 0, len(dropped)))) == 2
    # Stripping what is stripped changes nothing.
    again = slim.strip(mbox.read(spark, str(tmp_path / "kept.mbox")), rules.Options(strip=True))
    assert slim.kept_totals(again).first().stripped == 0
    # A second run finds the files there.
    list(slim_plan.run(spark, archive, run))
    index = (tmp_path / "att" / "attachments_index.csv").read_text("utf-8-sig").splitlines()
    assert {line.split(",")[3] for line in index[1:]} == {"duplicate"}


def test_kept_and_dropped_are_the_input(spark, archive):
    mail = mbox.read(spark, archive)
    p = slim_plan.plan(mail, rules.Rules(bulk=True), rules.Options())
    both = p.out.select("offset", "out_raw").union(p.dropped.select("offset", "raw"))
    assert both.exceptAll(mail.select("offset", "raw")).count() == 0 and both.count() == 5


def test_paths_and_options(archive, tmp_path):
    with pytest.raises(ValueError, match="input"):
        slim_plan.SlimOptions(out=archive, rules=rules.Rules(bulk=True)).check(archive)
    with pytest.raises(ValueError, match="also output"):
        slim_plan.SlimOptions(out="o", dropped_csv="./o", rules=rules.Rules(bulk=True)).check(archive)
    with pytest.raises(ValueError, match="nothing to do"):
        slim_plan.SlimOptions(out="o").check(archive)
    with pytest.raises(ValueError, match="required"):
        slim_plan.SlimOptions(rules=rules.Rules(bulk=True)).check(archive)


def test_programs(spark, archive, tmp_path, capsys):
    out = tmp_path / "report"
    assert list(stats_plan.run(spark, archive, stats_plan.StatsOptions(out=str(out))))
    assert {"general.csv", "largest_messages.csv", "labels.csv", "received_senders.csv"} <= set(os.listdir(out))
    assert "sent_bcc.csv" not in os.listdir(out)
    with io.open(out / "received_sender_domains.csv", encoding="utf-8-sig") as f:
        assert f.readline() == "domain,messages,size_mb,attachments,attachment_mb,bulk_messages,pct_of_total_size\n"
    assert cli.main(["slim", archive, "--dry-run", "--senders", str(out / "received_sender_domains.csv")]) == 0
    assert "dry" not in capsys.readouterr().err
    assert cli.main(["slim", archive, "-o", archive, "--drop-bulk"]) == 1


def test_rules_parse_once_and_never_shuffle_mail(spark):
    """Rules and stripping are one stage over the archive: one scan, one parse, no join, no exchange."""
    mail = spark.createDataFrame([("a", 0, 3, b"x")], "path string, offset bigint, length bigint, raw binary")
    rule = rules.Rules(drop=rules.compile_patterns(["a.org", "b*"]), keep=rules.compile_patterns(["c@d.org"]), labels=["spam"], bulk=True)
    p = slim_plan.plan(mail, rule, rules.Options(strip=True))
    for df, parses in ((p.classified, 1), (p.kept, 1), (p.out, 2)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("MapInArrow") == parses and text.count("ArrowEvalPython") == 1
        assert "Exchange" not in text and "Join" not in text


def test_matcher_agrees_with_joins(spark):
    patterns = rules.compile_patterns(["x@a.org", "@b.org", "b.org", "sub.b.org", "c*@*", "*@a.org", "a.org", "100%*", "org", "a@b@c"])
    senders = ["x@a.org", "y@a.org", "y@s.a.org", "z@sub.b.org", "z@xb.org", "c1@q.com", "100%@q.com", "1000@q.com", "q@q.net", "a@b@c", "org", "", None]
    df = spark.createDataFrame([(s,) for s in senders], "sender string")
    joined = {r.sender: r.idx for r in rules.match(df, rules.patterns_df(spark, patterns)).collect()}
    alone = {r.sender: r.idx for r in df.select("sender", rules.matched(df["sender"], patterns)["_0"].alias("idx")).where("idx IS NOT NULL").collect()}
    assert joined == alone and alone["x@a.org"] == 0 and alone["z@sub.b.org"] == 1 and alone["y@s.a.org"] == 6


def test_attachment_files_survive_retries(spark, tmp_path):
    (tmp_path / "old").write_bytes(b"before")
    rows = spark.createDataFrame([("old", b"new"), ("a", b"1"), ("a", b"1"), ("no/way", b"2")], "stored_as string, content binary")
    got = [(r.stored_as, r.is_new, r.warning is None) for r in files.write_attachments(rows.coalesce(1), str(tmp_path)).collect()]
    assert got == [("old", False, True), ("a", True, True), ("a", True, True), ("no/way", False, False)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "old"] and (tmp_path / "old").read_bytes() == b"before"
