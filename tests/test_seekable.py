"""Compressed archives, and what the round trip of a large one takes on disk."""

import datetime
import os
import random
import shutil

import pyarrow as pa
import pytest

from postern import corpus
from postern.plans import queries
from postern.sinks import files
from postern.sources import mbox, seekable

from test_archive import ARCHIVE


def packed(tmp_path, raw, frame, monkeypatch, name="a.zst"):
    monkeypatch.setattr(seekable, "FRAME_BYTES", frame)
    with open(tmp_path / name, "wb") as f:
        out = seekable.Writer(f)
        for at in range(0, len(raw), 11):
            out.write(raw[at : at + 11])
        out.flush()
        f.write(seekable.table(out.sizes))
    return str(tmp_path / name)


@pytest.mark.parametrize("frame", [1, 2, 5, 64, 1 << 20])
def test_frames_are_the_bytes(tmp_path, monkeypatch, frame):
    path, rng = packed(tmp_path, ARCHIVE, frame, monkeypatch), random.Random(frame)
    with mbox.opened(path) as data:
        assert len(data) == len(ARCHIVE)
        for _ in range(2000):
            a, b = rng.randrange(len(ARCHIVE) + 9), rng.randrange(len(ARCHIVE) + 9)
            assert data[a:b] == ARCHIVE[a:b], (a, b)
            what = rng.choice([b"\nFrom ", b"\n", b"\n\n", b"zzzz", b"--B--\n\nFrom u"])
            assert data.find(what, a, b) == ARCHIVE.find(what, a, b) and data.find(what, a) == ARCHIVE.find(what, a)
        for size in (1, 7, 90, 10_000):
            got = [r for at in range(0, len(data), size) for r in mbox.ranges(data, at, min(len(data), at + size))]
            assert got == list(mbox.ranges(ARCHIVE, 0, len(ARCHIVE))), size


def test_other_tools_read_it_and_broken_files_are_refused(tmp_path, monkeypatch):
    path = packed(tmp_path, ARCHIVE, 100, monkeypatch)
    with pa.input_stream(path, compression="zstd") as f:
        assert f.read() == ARCHIVE
    with open(path, "rb") as f:
        whole = f.read()
    for broken in (b"", b"x", whole[:-1], whole[5:], pa.compress(ARCHIVE, "zstd", asbytes=True)):
        with pytest.raises(ValueError, match="seekable"):
            seekable.Frames(broken)


@pytest.mark.parametrize("name", ["copy.mbox", "copy.mbox.zst"])
def test_roundtrip_packed_and_plain(spark, tmp_path, name):
    (tmp_path / "all.mbox").write_bytes(ARCHIVE)
    out = str(tmp_path / name)
    assert files.write_mbox(mbox.read(spark, str(tmp_path / "all.mbox"), split_bytes=64), out) == len(ARCHIVE)
    for size in (50, 1 << 20):
        rows = mbox.read(spark, out, split_bytes=size).orderBy("offset").collect()
        assert b"".join(bytes(r.raw) for r in rows) == ARCHIVE and len(rows) == 5
    rows = spark.createDataFrame([("f", i, bytearray(raw)) for i, raw in enumerate([b"a", b"", b"b\n", b"c"])], "path string, offset bigint, raw binary")
    assert files.write_mbox(rows, out) == 5
    with mbox.opened(out) as data:
        assert data[0:5] == b"a\nb\nc"
    files.write_mbox(rows.where("false"), out)
    with pytest.raises(Exception, match="is empty"):
        mbox.read(spark, out).count()


def test_many_ranges_share_tasks(tmp_path, monkeypatch):
    path = packed(tmp_path, ARCHIVE, 100, monkeypatch)
    monkeypatch.setattr(mbox, "TASKS", 3)
    for split in (1, 7, 1 << 20):
        reader = mbox.MboxReader({"path": path, "splitBytes": str(split)})
        parts = reader.partitions()
        assert len(parts) <= 3 and all(p.split == split for p in parts)
        assert b"".join(raw for p in parts for batch in reader.read(p) for raw in batch.column("raw").to_pylist()) == ARCHIVE


def test_parts_go_as_they_are_joined(spark, tmp_path, monkeypatch):
    """The archive and one part are on disk at most, not the archive and all of its parts."""
    rows = spark.range(0, 1600).repartition(2).selectExpr("'f' AS path", "id AS offset", "encode(concat('x', repeat(id % 10, 999)), 'utf-8') AS raw")
    rows = rows.repartitionByRange(16, "path", "offset").sortWithinPartitions("path", "offset")
    copy, seen = shutil.copyfileobj, []

    def counted(*args):
        copy(*args)
        args[1].flush()
        seen.append(sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(tmp_path) for x in names))

    monkeypatch.setattr(files.shutil, "copyfileobj", counted)
    total = files.write_mbox(rows, str(tmp_path / "all.mbox"), ordered=True)
    assert len(seen) == 16 and max(seen) < 1.2 * total == 1.2 * (1600 * 1001 - 1)


def tables(spark, folder):
    """Orders without items, items without an order, orders of no customer, two orders of one key, nulls."""
    day = datetime.datetime(2020, 1, 2)
    orders = [(k, k % 7, "FOP"[k % 3], 10.5 * k, day, "1-URGENT") for k in range(300)] + [(5, 2, "P", 1.0, day, "2-HIGH"), (900, 77, "O", 1.0, day, "2-HIGH")]
    lines = [(k, n, 1000 * k + n, float(n * 9)) for k in range(0, 320, 2) for n in range(1, 1 + k % 6)] + [(4, 1, 3, 50.0), (4, 9, 3, None), (4, 9, None, 2.0)]
    customers = [(k, f"Customer#{k}", k % 5, "BUILDING", "more") for k in range(6)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(customers, "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string, k string").write.parquet(f"{folder}/customer.parquet")


def test_ordered_mail_is_the_mail(spark, tmp_path):
    tables(spark, tmp_path)
    plain, ordered = corpus.order_mail(spark, str(tmp_path)), corpus.ordered_order_mail(spark, str(tmp_path))
    assert plain.schema == ordered.schema and plain.count() == ordered.count() == 259
    assert plain.exceptAll(ordered).count() == ordered.exceptAll(plain).count() == 0
    keys = [r.offset for r in ordered.select("offset").collect()]
    assert keys == sorted(keys)


def test_roundtrip_moves_and_keeps_little(spark, tmp_path, monkeypatch):
    """The archive lies in the shared folder and is small beside its mail, and no exchange moves the text of a message."""
    tables(spark, tmp_path)
    made = []
    monkeypatch.setattr(queries.files, "write_mbox", lambda mail, path, *a, f=files.write_mbox, **b: made.append((mail, path, f(mail, path, *a, **b))))
    got = queries.roundtrip_mbox(spark, str(tmp_path)).first()
    (mail, path, size), = made
    plain = corpus.order_mail(spark, str(tmp_path)).selectExpr("count(1) AS n", "sum(length) AS b").first()
    assert (got.msgs, got.bytes) == (plain.n, plain.b) and size == plain.b
    assert path.startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/")
    assert os.path.getsize(path) < size / 4 and os.listdir(os.path.dirname(path)) == [os.path.basename(path)]
    moved = mail._jdf.queryExecution().executedPlan().toString()
    assert "Content-Type" in moved[: moved.index("Exchange")] and "Content-Type" not in moved[moved.index("Exchange") :]
