"""Nulls, empty tables, repeated rows, clashing columns, ties and very long texts, for every operator."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netmine.llm import bpe, chat_format, decontaminate, html_extract, line_dedup, near_dedup, quality_model, quality_rules, secret_scan, url_filter

LONG = " ".join(f"word{i % 5000} and{i % 77}" for i in range(150_000))  # 2 MB


def clash(df):
    """Extra columns named like what operators use inside."""
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("packed", "place", "found", "__key", "score", "hit", "items", "n_words"))])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG), (2, None), (3, ""), (None, "no id"), (None, None), (4, "same"), (4, "same"), (5, "same"), (6, LONG + " end")]
    return clash(spark.createDataFrame(rows, "doc_id long, text string"))


def test_quality_rules(spark, docs):
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == 9 and {r.n_words for r in rows if r.doc_id == 1} == {300_000}
    assert sum(r.doc_id == 4 for r in rows) == 2 and quality_rules.judge(docs.limit(0)).count() == 0


def test_kept_is_the_threshold_table(spark):
    """`kept` computed again, row by row, from the measures and the table."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "a#", "word", "x", "||", "and"]) for _ in range(rng.randint(0, 120))) + rng.choice(["", "\nsame line here\nsame line here"])) for i in range(200)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.kept for r in got} == {True, False}
    assert not any(r.kept and r.base_failed for r in got)
    again = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()}
    assert again == {r.doc_id: r.kept for r in got}


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1), (6, 0), (4, 1), (5, None)], "doc_id long, quality int")
    w = quality_model.train(docs, labels)
    rows = quality_model.scores(spark, docs, w).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    kept = quality_model.keep_good(spark, docs, w)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality_model.scores(spark, docs.limit(0), w).count() == 0
    assert quality_model.train(docs.limit(0), labels).any() == np.False_


def slow_features(text):
    """Slots and values of a text, gram by gram."""
    words = text.split()
    f = quality_model.Features()
    core = [f._word(w) >> 31 for w in words]
    shape = []
    for i, w in enumerate(words):
        near = any(core[j] == core[i] for j in range(max(0, i - quality_model.NEARBY), i))
        shape.append(2 * (f._word(w) & 0x7FFFFFFF) + near)
    out, top = {}, 1 << 64
    for salt, x in ((0x9E3779B97F4A7C15, core), (0xC2B2AE3D27D4EB4F, shape)):
        h = [v * salt % top for v in x]
        grams = h + [(a * 0x94D049BB133111EB + b + 1) % top for a, b in zip(h, h[1:])]
        slots = [((g ^ g >> 31) * salt % top >> 40) & ((1 << quality_model.BITS) - 1) for g in grams]
        for s in set(slots):
            out.setdefault(s, []).append((slots.count(s) / len(slots)) ** 0.5)
    return out


def slow_training(rows, spark):
    """Follow-the-regularised-leader over dictionaries, one coordinate after another."""
    z, n, bias = {}, {}, "bias"
    q = quality_model
    order = spark.createDataFrame([(e, i) for e in range(q.EPOCHS) for i, *_ in rows], "epoch int, doc_id long").select("epoch", "doc_id", F.xxhash64("epoch", "doc_id").alias("h")).collect()
    by = {i: (slow_features(t), y) for i, t, y in rows}

    def weight(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= q.L1 else -(v - (1 if v > 0 else -1) * q.L1) / ((q.BETA + n.get(k, 0.0) ** 0.5) / q.ALPHA + q.L2)

    for r in sorted(order, key=lambda r: (r.epoch, r.h)):
        x, y = by[r.doc_id]
        terms = [(k, np.float32(v)) for k, vs in x.items() for v in vs] + [(bias, 1.0)]
        p = 1 / (1 + np.exp(-sum(weight(k) * float(v) for k, v in terms)))
        step = []
        for k, v in terms:
            g = (p - y) * float(v) * (1.0 if y else q.REJECTED_WEIGHT)
            step.append((k, g, ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / q.ALPHA, weight(k)))
        for k, g, sigma, w in step:
            z[k] = z.get(k, 0.0) + g - sigma * w
            n[k] = n.get(k, 0.0) + g * g
    return lambda text: 1 / (1 + np.exp(-(weight(bias) + sum(weight(k) * v for k, vs in slow_features(text).items() for v in vs))))


def test_classifier_against_loops(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        y = i % 3 > 0
        rows.append((i, " ".join(rng.choice(["alpha", "Beta", "g7", "delta,"] if y else ["###x", "alpha", "$$$", "zz!"]) for _ in range(rng.randint(1, 30))), int(y)))
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r.doc_id: r.score for r in quality_model.scores(spark, d.select("doc_id", "text"), quality_model.train(d.select("doc_id", "text"), d.select("doc_id", "quality"))).collect()}
    score = slow_training([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2], spark)
    assert all(abs(got[i] - score(t)) < 1e-4 for i, t, _ in rows)


def test_training_rows_are_bounded(spark):
    d = spark.createDataFrame([(i % 20, f"text {i}") for i in range(400)], "doc_id long, text string")  # ids repeat
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    rows = quality_model.training_rows(d, labels, 10).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 10


def test_secrets(spark, docs):
    rows = secret_scan.digest(docs).collect()
    assert len(rows) == 9
    hidden = spark.createDataFrame([(None, "password=abcdefg"), (None, "none"), (7, LONG + " secret: abcdef1"), (7, "x")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_assign) for r in secret_scan.digest(clash(hidden)).collect())
    assert got == [(False, 0), (False, 1), (True, 0), (True, 1)]


def test_lines(spark, docs):
    rows = line_dedup.clean(docs).collect()
    left = sorted(((r.doc_id, r.text) for r in rows), key=str)
    assert line_dedup.clean(docs).columns == docs.columns and len(rows) == 9
    assert (6, "") in left and (5, "") in left and (None, "no id") in left and (None, None) in left and (2, None) in left
    assert [t for d, t in left if d == 4] == ["same", "same"]  # one document in two rows
    one = spark.createDataFrame([(1, "\n".join(["a line that repeats", LONG[:100_000], "a line that repeats", "", "  "]))], "doc_id long, text string")
    assert line_dedup.clean(one).first().text == "\n".join(["a line that repeats", LONG[:100_000], "", "  "])
    wide = ["пример длинной строки текста " * 4, "пример длинной строки текста " * 4 + "да", "другая строка совсем о другом, и тоже длинная"]
    got = [r.text for r in line_dedup.clean(spark.createDataFrame(list(enumerate(wide)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [wide[0], "", wide[2]]


def test_near_duplicates(spark, docs):
    rows = near_dedup.near_duplicates(docs).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 9 and by[6].component_id == 1 and by[5].component_id == 4 and by[2].kept and by[3].kept


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(None, "word1 and1 word2 and2"), ("x", LONG[:30_000]), (None, None)], "item_id string, text string")
    rows = decontaminate.find(spark, docs, bench).collect()
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert len(rows) == 9 and by[1].n_items == 1 and by[1].n_hit > 4000 and not by[4].contaminated
    cleaned = decontaminate.clean(spark, docs, bench)
    assert cleaned.columns == docs.columns and cleaned.count() == 9


def test_long_items_in_parts(spark, monkeypatch):
    """An item longer than a part is cut with an overlap, so no window is lost."""
    words = [f"i{k}" for k in range(200)]
    d = spark.createDataFrame([(1, "a " + " ".join(words) + " b"), (2, " ".join(words[45:60])), (3, " ".join(words[45:53]))], "doc_id long, text string")
    bench = spark.createDataFrame([("x", " ".join(words))], "item_id string, text string")
    monkeypatch.setattr(decontaminate, "PART_WORDS", 50)
    assert {r.doc_id: r.n_hit for r in decontaminate.find(spark, d, bench).collect()} == {1: 200, 2: 15, 3: 0}
    assert [r.text for r in decontaminate.clean(spark, d, bench).orderBy("doc_id").collect()] == ["a  b", "", " ".join(words[45:53])]


def test_byte_pairs(spark, docs):
    pytest.importorskip("public_tokenizers")
    kinds = docs.where("doc_id IS NULL OR doc_id <> 6").withColumn("flag", F.lit(True)).withColumn("day", F.lit("2020-01-01").cast("date")).withColumn("list", F.array(F.lit(1)))
    rows = bpe.digests(spark, kinds, bpe.public_vocabulary(), ["doc_id", "flag", "day", "list"]).collect()
    assert len(rows) == 8 and all(r.flag and r.list == [1] for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and by[2].n_tokens == by[3].n_tokens == 0


def test_urls(spark):
    rules = [url_filter.Rule("com", "/", "allow"), url_filter.Rule("a.com", "/", "block"), url_filter.Rule("com", "/ab", "block")]
    rows = [(1, "http://a.com/ab"), (1, "http://a.com/ab"), (None, "http://x.com/" + "p" * 500_000), (2, None), (3, "http://" + "s." * 300 + "com/")]
    for most in (url_filter.MAX_INDEX_BYTES, 0):
        got = sorted(((r.page_id, r.rule, len(r.path)) for r in url_filter.judge(spark, clash(spark.createDataFrame(rows, "page_id long, url string")), rules, most).collect()), key=str)
        assert got == sorted([(1, "a.com/", 3), (1, "a.com/", 3), (None, "com/", 500_001), (2, None, 0), (3, "com/", 1)], key=str)  # of a tie the longer host


def test_chat(spark):
    said = LONG[:300_000]
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", said), (None, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x")]
    talks = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_events(chat_format.messages_as_events(talks))).collect()}
    assert got[1].loss_chars == len(said) and got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[2].n_turns == 2 and got[None].n_turns == 1
    assert got[1].turns_sha256 == hashlib.sha256(f"user\nq\nassistant\n{said}\n".encode()).hexdigest()


def test_pages(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (1, "u", f"<article><p>{LONG}</p></article>"), (None, None, None)]
    got = html_extract.extract(clash(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted(r.n_chars for r in got) == [0, len(LONG), len(LONG)]
