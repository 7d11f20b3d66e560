"""Quality rules, exact dedup, chat format, mixing, packing: against plain Python on small tables."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from postern.llm import chat_format, exact_dedup, mixing, packing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string"
LOOP = "a b c d e f g h "
TEXTS = [
    None,
    "",
    " \n\t ",
    "one two",
    LOOP * 4,
    LOOP + "x " + LOOP,
    "line\nline\n\n \nother\nline",
    "# * $ %% plain | <b>",
    "ÉÀ " * 30,
    "w" * 5000,
    " ".join(f"word{i % 37}" for i in range(6000)),
    " ".join(f"unique{i}" for i in range(40)),
]


def repeated(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = {w: windows.count(w) for w in set(windows)}
    return len({i + o for i, w in enumerate(windows) if counts[w] > 1 for o in range(8)})


def test_quality_measures(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one two"), (None, "x")]
    got = quality_rules.apply_policy(quality_rules.ledger(spark.createDataFrame(rows, DOCS))).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text in enumerate(TEXTS):
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = by_id[i]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        n = repeated(words) if len(words) < 1000 else 6000
        assert r.n_repeat_words == n
        assert r.base_failed == (len(words) < 20 or 100 * n > 30 * len(words))
        assert not (r.base_failed and r.kept)
    assert by_id[11].kept


def test_quality_rows_and_ablation(spark):
    docs = spark.createDataFrame([(1, TEXTS[11], 5), (2, "x", 6)], "doc_id bigint, text string, kept int")
    kept = quality_rules.kept_rows(docs)
    assert kept.columns == docs.columns and [r.kept for r in kept.collect()] == [5]
    led = quality_rules.ledger(docs)
    ablated = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(led).collect()}
    assert set(ablated) == set(quality_rules.POLICIES["v1"]) and ablated["few_words"][0] == 1
    assert quality_rules.ledger(docs.where("false")).count() == 0


def test_no_python_in_native_plans(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id bigint, text string, source string")
    convs = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    frames = [quality_rules.ledger(docs), chat_format.read_back(chat_format.examples(convs)), mixing.mixed(docs)]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("carry", [False, True])
def test_dedup(spark, keep, carry):
    rnd = random.Random(3)
    texts = ["same " * 40, None, "", "a", "b", "é" * 70, "é" * 70 + "x", "L" * 200_000]
    rows = [(i, rnd.choice(texts), "t") for i in range(300)] + [(None, "a", "t"), (None, "only null", "t"), (7, "twice", "t"), (7, "twice", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    got = exact_dedup.dedup(docs.repartition(5), keep=keep, carry=carry).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for digest in {r.text_sha256 for r in got}:
        mine = [r for r in got if r.text_sha256 == digest]
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == digest)
        ids = [i for i in groups[text] if i is not None]
        best = (min if keep == "min" else max)(ids, default=None)
        assert {r.keep_id for r in mine} == {best} and {r.group_size for r in mine} == {len(groups[text])}
        assert [r.doc_id for r in mine if r.kept] == [best]
        if carry:
            assert {r["__row"].kept for r in mine} == {"t"}
    assert exact_dedup.dedup(docs.where("false")).count() == 0


def test_dedup_runs_over_partition_edges(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.dedup(docs)
    row = got.agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.max("group_size").alias("most")).first()
    assert (row.kept, row.most) == (501, 4500)
    assert got.where("text_sha256 = sha2('hot', 256)").select("keep_id").distinct().collect()[0].keep_id == 4998


def test_chat(spark):
    nasty = ["<turn user>\n", "</turn>\n", "\\l\\b\\\\", "a\nb", "", None, "x>y<z", "é🙂"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "first"), (2, 1, "assistant", "second"), (2, 2, "to<ol>", "tail"), (3, 0, "user", "no reply"), (3, 0, "user", "no reply")]
    rows += [(None, None, None, None), (4, 0, "user", "q" * 50_000), (4, 1, "assistant", "r" * 50_000)]
    convs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("example", F.lit(1))
    made = chat_format.examples(convs)
    for r in made.where("trainable").collect():
        target = r.formatted[r.loss_start : r.loss_start + r.loss_chars]
        assert r.formatted.endswith(target + chat_format.CLOSE)
    assert made.where("conv_id = 2").count() == 3 and made.where("conv_id = 3").count() == 1
    got = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t))
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_text == "".join(f"{role}\n{text}\n" for _, role, text in turns)
        assert got[conv].loss_text == "".join(text for _, role, text in turns if role == "assistant")
    assert chat_format.examples(convs.where("false")).count() == 0


def test_mixing(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 60)) if i % 50 else None, rnd.choice(["hot"] * 6 + ["b", "c", None, "é"])) for i in range(2000)]
    rows += [(9, "w " * 20_000, "hot"), (None, "w", "b"), (None, "w", "b"), (5000, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("taken", F.lit(0))
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    names = sorted((s for s in sizes if s is not None)) + [None]
    target, open_, rest = {}, {s: w for s, w in zip(names, [1, 2, 3, 1, 2, 3], strict=False)}, sum(sizes.values())
    while True:
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            rest -= target[s]
            del open_[s]
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(target[s]) and mine[0].source_size == sizes[s]
        taken = sum(r.taken for r in mine)
        assert abs(taken - target[s]) <= max(r.size for r in mine) + 0.02 * target[s]
        assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in mine)
    again = {(r.doc_id, r.size, r.source): r.copies for r in mixing.mixed(docs.repartition(7)).where("doc_id IS NOT NULL AND size > 0").collect()}
    assert all(again[r.doc_id, r.size, r.source] == r.copies for r in got if r.doc_id is not None and r.size)
    assert mixing.mix(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mixed(docs.where("false")).count() == 0


def padding(bounds, cells):
    return sum(next(b for b in bounds if b >= top) * n - total for top, n, total in cells)


def test_bucket_boundaries_are_optimal():
    from itertools import combinations

    rnd = random.Random(1)
    for _ in range(40):
        tops = sorted(rnd.sample(range(0, 200), rnd.randrange(1, 11)))
        cells = [(t, (n := rnd.randrange(1, 50)), t * n) for t in tops]
        for k in (1, 2, 3, 5):
            got = packing.boundaries(cells, k)
            best = min(padding([*c, tops[-1]], cells) for j in range(min(k, len(tops))) for c in combinations(tops[:-1], j))
            assert len(got) <= k and got[-1] == tops[-1] and padding(got, cells) == best
    assert packing.boundaries([]) == []


def test_packing(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 5, 5, 90, 700, 3000])) for i in range(400)] + [(None, None), (3, "w"), (900, "w " * 20_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("bucket", F.lit("x"))
    got = packing.packed(docs, buckets=4, budget=2000).collect()
    assert len(got) == len(rows) and len({r.boundary for r in got}) <= 4
    batches = {}
    for r in got:
        assert r.length <= r.boundary
        batches.setdefault(r.batch_id, []).append(r)
    for rows_ in batches.values():
        assert len({r.bucket for r in rows_}) == 1 and sorted(r.slot for r in rows_) == list(range(len(rows_)))
        assert len(rows_) == 1 or len(rows_) * rows_[0].boundary <= 2000
    # No choice of four boundaries pads less.
    lengths = [r.length for r in got]
    inner = [n for n in set(lengths) if n != max(lengths)]
    padding = [
        sum(min(b for b in (*chosen, max(lengths)) if b >= n) - n for n in lengths) for chosen in itertools.combinations(inner, 3)
    ]
    assert sum(r.boundary - r.length for r in got) == min(padding)
    cells = packing.histogram(spark.createDataFrame([(n,) for n in (1, 1023, 1025, 1026, 5000, 5001, 5001)], "length bigint"))
    assert cells == [(n, c, n * c) for n, c in ((1, 1), (1023, 1), (1025, 1), (1026, 1), (5000, 1), (5001, 2))]
    assert packing.packed(docs.where("false")).count() == 0
