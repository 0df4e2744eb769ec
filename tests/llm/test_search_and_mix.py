"""MaxScore search, fill-in-the-middle and mixing against loops, with their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netmine.llm import fill_middle, lexical_search, mixing

LONG = " ".join(f"word{i % 5000} and{i % 77}" for i in range(100_000))


def clash(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("shard", "term", "score", "size", "h", "bucket", "place", "output", "form", "n"))])


# ---------------------------------------------------------------- ranked search


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def slow_rank(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, query in asked.items():
        scores = []
        for i, w in held:
            m, tf, score = 10 + 90 * len(w) * n_docs // n_terms, Counter(w), 0
            for t in query & set(tf):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("postings, block", [(40, 2), (1 << 20, 1000)])
def test_search_over_shards_and_blocks(spark, postings, block):
    rng = random.Random(postings)
    words = ["the", "a", "The", "über", "日本", "x1", "of", "rare", "Rare"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, weights=[30, 20, 5, 3, 2, 3, 20, 1, 1] + [2] * 30, k=rng.randint(1, 25)))) for i in range(150)]
    docs += [(1000 + i, docs[3][1]) for i in range(15)] + [(7, docs[7][1]), (None, "rare rare"), (None, None), (2000, ""), (2001, "-- !"), (2002, LONG)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(12)] + [(50, docs[3][1]), (51, ""), (52, None), (53, "nowhere"), (None, "the rare"), (3, "rare 日本"), (54, "the the of")]
    table = clash(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    asked = clash(spark.createDataFrame(items, "item_id long, text string"))
    index = lexical_search.build(table, postings)
    assert (index.rows.select("shard").distinct().count() > 20) == (postings == 40)
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(index, asked, block=block).collect()), key=repr)
    assert got == slow_rank(docs, items)
    few = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(index, asked, k=3).collect()), key=repr)
    assert few == slow_rank(docs, items, 3)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert lexical_search.rank(docs.limit(0), items).count() == 0 and lexical_search.rank(docs, items.limit(0)).count() == 0
    assert lexical_search.rank(docs.select("doc_id", F.lit(None).cast("string").alias("text")), items).count() == 0


def test_probing_skips_documents_that_cannot_qualify():
    """Lists with one strong term: the weak list is not scanned for new documents, and results are those of a full sum."""
    rng = np.random.default_rng(1)
    ids = np.arange(5000)
    for _ in range(30):
        lists, full = [], np.zeros(5000, np.int64)
        for size, top in ((30, 10_000), (400, 900), (4000, 50), (4900, 3)):
            at = np.sort(rng.choice(5000, size, replace=False)).astype(np.int32)
            gains = rng.integers(1, top, size)
            lists.append(lexical_search.Postings(at, gains, int(gains.max())))
            full[at] += gains
        acc = np.zeros(5000, np.int64)
        found, scores = lexical_search.best(lists, acc, ids, 10)
        want = np.lexsort((ids, -full))[:10]
        assert found.tolist() == want.tolist() and scores.tolist() == full[want].tolist() and not acc.any()


# ---------------------------------------------------------------- fill in the middle


def slow_cut(doc_id, text, pattern, seed=7):
    units = re.findall(pattern, text or "")
    g = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text or ""
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit, pattern", [("line", r"[^\n]*\n|[^\n]+"), ("word", r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), ("char", r"(?s).")])
def test_cuts_and_their_way_back(spark, unit, pattern):
    rng = random.Random(1)
    texts = ["", None, "\n", "\n\n\n", "one", "<P> x", "a<M>b\n", "<P", "<S>", "P>\n<S\n", "日本\n𝄞𝄞\r\n x", LONG, "end\n"] + ["".join(rng.choices("ab\n <>PSM𝄞", k=rng.randint(1, 60))) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (3, "\n\n\n")]
    setting = fill_middle.Setting(unit=unit)
    made = fill_middle.fill_in_middle(clash(spark.createDataFrame(docs, "doc_id long, text string")), setting)
    want = sorted(((i, *slow_cut(i, t, pattern)) for i, t in docs), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=repr) == want
    back = sorted(((r.doc_id, r.text) for r in fill_middle.restored(made).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in docs), key=repr)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def test_rates_and_digest(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd\n").alias("text"))
    forms = Counter(r.form for r in fill_middle.fill_in_middle(docs, fill_middle.Setting(rate=40, spm=100)).collect())
    assert set(forms) == {"plain", "spm"} and 80 < forms["spm"] < 160
    for r in fill_middle.digest(docs).collect():
        assert r.restored_sha256 == hashlib.sha256(b"a\nb\nc\nd\n").hexdigest() and r.output_sha256 == hashlib.sha256(slow_cut(r.doc_id, "a\nb\nc\nd\n", r"[^\n]*\n|[^\n]+")[4].encode()).hexdigest()
    assert fill_middle.digest(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.restore("x", "psm")


# ---------------------------------------------------------------- mixing


def slow_targets(sizes, weights=(5, 2, 1)):
    """Shares by weight, what is above a bound shared again until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        above = [s for s in free if left * w[s] / total > 2 * sizes[s]]
        if not above:
            return out | {s: left * w[s] / total for s in free}
        for s in above:
            out[s] = 2.0 * sizes[s]
            free.remove(s)
        left -= sum(out[s] for s in above)
    return out


def drawn(rng, n):
    sources = ["b", "a", "Z", None, "é", "日", "", "a!"]
    docs = [(i, rng.choices(sources, weights=[60, 5, 5, 5, 5, 5, 5, 10])[0], " ".join(["w"] * rng.choice([0, 1, 2, 3, 7, 50, rng.randint(1, 400)]))) for i in range(n)]
    return docs + [(10_000 + i, "b", "copy of one text " * 3) for i in range(n // 2)] + [(None, "a", "x y"), (5, "b", "again"), (5, "b", "again"), (77, "only empty", ""), (78, "one", LONG[:40_000])]


def test_targets_sizes_and_reruns(spark):
    docs = drawn(random.Random(3), 600)
    table = clash(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    got = mixing.mix(table).collect()
    size = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, s, t in docs)
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = slow_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.times * r.size
        taken[r.source] += r.taken
    for s in sizes:
        if s != "one":  # a single document is taken whole or not at all
            assert 0 <= want[s] - taken[s] <= 1, s
    again = mixing.mix(table.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    other = mixing.mix(table, seed=99).collect()
    assert Counter(map(tuple, got)) != Counter(map(tuple, other))


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.digest(none).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixing.digest(one).collect()] == [(0, 0, 0.0, 0)]


def test_knapsack_against_all_subsets():
    rng = random.Random(8)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), rng.randint(1, 5))
        counts = [rng.randint(0, 4) for _ in lengths]
        budget = rng.randint(0, 80)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = mixing.knapsack(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert sum(n * t for n, t in zip(lengths, take)) == max(s for s in sums if s <= budget)


def test_share_of_every_length_is_even():
    """Before the remaining words are fitted, every length gives its share."""
    lengths, counts = [400, 200, 100, 50, 10], [1000, 1000, 1000, 1000, 1000]
    whole, take = mixing.fit(lengths, counts, 0.25 * 760_000, reserve=1000)
    assert whole == 0 and sum(n * t for n, t in zip(lengths, take)) == 190_000 and all(230 <= t <= 280 for t in take[:4])
    assert mixing.fit(lengths, counts, 2 * 760_000) == (2, [0] * 5) and mixing.fit([], [], 0) == (0, [])
