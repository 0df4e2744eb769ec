"""The corpus pipeline, every stage against what it should do to its own input."""

import hashlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from netmine.llm import decontaminate, line_dedup, near_dedup, quality_model  # noqa: E402
import test_duplicates as brute  # noqa: E402


def corpus():
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [line(14) for _ in range(4)]
    shared = [line(60) for _ in range(2)]
    docs, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        parts = [line(rng.randint(8, 20)) for _ in range(rng.randint(2, 5))]
        if i % 10 == 3:
            parts.insert(1, rng.choice(shared))
        if i % 9 == 2:
            parts.append("see " + rng.choice(passages) + " there")
        text = "\n".join(parts)
        if bad:
            text = " ".join(w + ("###" if rng.random() < 0.5 else "") for w in text.split(" "))
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad)))
    for i in range(160, 190):  # near copies of good documents, in one line
        base = docs[rng.choice([k for k in range(160) if k % 4])][1].replace("\n", " ").split(" ")
        base[rng.randrange(len(base))] = word()
        docs.append((i, " ".join(base), "en", "s", 0))
    docs += [(300, None, None, "s", None), (301, "", "en", None, 0), (None, "a text without an id", "en", "s", 20), (302, docs[1][1], "en", "s", 5)]
    bench = [(f"q{k}", p) for k, p in enumerate(passages)] + [("none", None)]
    return docs, labels, bench


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    docs, labels, bench = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "near_dedup", "decontaminate", "bpe"]

    # the classifier: those that its own scores reject go, the others stay as they are
    good = stages["quality_classifier"](spark, docs, folder)
    weights = quality_model.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    wanted = {r.doc_id for r in quality_model.scores(spark, docs, weights).collect() if r.predicted}
    before, after = dict(rows_of(docs)), rows_of(good)
    assert good.columns == docs.columns and {d for d, _ in after} == wanted and all(before[d] == t for d, t in after)
    assert len([d for d in wanted if d is not None and d < 160 and d % 4 == 0]) <= 4
    good.write.parquet(f"{folder}/one")
    now = spark.read.parquet(f"{folder}/one")

    # lines: against all pairs
    lines = stages["line_dedup"](spark, now, folder)
    want = brute.brute_lines(rows_of(now))
    got = rows_of(lines)
    assert lines.columns == docs.columns and sorted(got, key=str) == sorted(((d, want[d, t]) for d, t in rows_of(now)), key=str)
    assert all(r.n_chars == len(r.text or "") for r in lines.collect())
    lines.write.parquet(f"{folder}/two")
    now = spark.read.parquet(f"{folder}/two")

    # near copies: against all pairs of shingles of five words
    near = stages["near_dedup"](spark, now, folder)

    def five(text):
        w = brute.words_of(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets = {d: five(t) for d, t in rows_of(now) if d is not None}
    ids = sorted(sets)
    label = brute.groups(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    kept = [(d, t) for d, t in rows_of(now) if d is None or label[d] == d]
    assert near.columns == docs.columns and sorted(rows_of(near), key=str) == sorted(kept, key=str)
    assert len(kept) < len(rows_of(now))
    near.write.parquet(f"{folder}/three")
    now = spark.read.parquet(f"{folder}/three")

    # passages: no window is left that was there, everything else is
    clean = stages["decontaminate"](spark, now, folder)
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = {r.doc_id: r for r in decontaminate.find(spark, now, bench).collect()}
    was = dict(rows_of(now))
    assert clean.columns == docs.columns and any(r.contaminated for r in found.values())
    for d, t in rows_of(clean):
        left, last = "", 0
        for a, b in ((x.start, x.end) for x in found[d].spans):
            left, last = left + was[d][last:a], b
        assert t == (None if was[d] is None else left + was[d][last:])
    assert decontaminate.find(spark, clean, bench).where("n_hit >= 10").count() == 0
    clean.write.parquet(f"{folder}/four")
    now = spark.read.parquet(f"{folder}/four")

    # ids: a round trip
    coded = stages["bpe"](spark, now, folder).collect()
    texts = dict(rows_of(now))
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in coded) and len(coded) == len(texts)

    # all together
    whole = sorted(((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    assert whole == sorted(((r.doc_id, r.ids_sha256) for r in coded), key=str)


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_stages_keep_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS packed", "'x' AS score", "array(1) AS hit", "2L AS place", "true AS items")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.count() > 0
    assert line_dedup.digest(docs).count() == docs.count() == near_dedup.near_duplicates(docs).count()


def test_stages_on_repeated_ids_and_very_long_texts(spark, folder):
    """Rows that share an id, a text of megabytes, nulls in every column: no stage fails, loses a row without cause or changes a column's type."""
    rng = random.Random(3)
    long = "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6_000))
    rows = [(1, "first text of this id, long enough to stand", "en", "s", 5), (1, "second text of this id, which is another", "en", "s", 5), (2, long, None, None, None)]
    rows += [(3, long + "\nand one line more at its end", "de", "t", 1), (None, None, None, None, None), (4, "", "", "", 0), (4, "", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        got = out.collect()
        ids = [r.doc_id for r in got]
        if name == "quality_classifier":
            assert set(ids) <= {1, 2, 3, 4, None}
        elif name == "near_dedup":
            assert sorted(map(str, ids)) == sorted(map(str, [1, 1, 2, None, 4, 4]))  # the longer copy goes
        else:
            assert sorted(map(str, ids)) == sorted(map(str, [1, 1, 2, 3, None, 4, 4]))
        if name != "bpe":
            assert out.schema.simpleString() == docs.schema.simpleString()
        if name == "line_dedup":  # the copied lines go once, from one of the two
            assert sum(len(r.text or "") for r in got if r.doc_id in (2, 3)) < len(long) + 100
