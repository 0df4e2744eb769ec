import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netmine.llm import line_dedup, linking, near_dedup


def words_of(text):
    return (text or "").encode().translate(near_dedup.LOWER).split()


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def groups(ids, linked):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_docs(rows):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(t))
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if any(x and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    return groups(ids, links)


def corpus(rng, n_copies):
    word = lambda k: f"w{rng.randrange(k)}"
    rows, i = [], 0

    def add(t):
        nonlocal i
        rows.append((i, t))
        i += 1

    for size in (1, 2, 3, 5, 8, 16, 21, 40, 150, 600):
        for _ in range(3):
            base = [word(5000) for _ in range(size)]
            add(" ".join(base))
            for edits in (0, 1, 2, max(1, size // 25), max(1, size // 12), max(1, size // 9)):
                t = list(base)
                for _ in range(edits):
                    t[rng.randrange(len(t))] = word(5000)
                add(" ".join(t))
    centre = [word(9000) for _ in range(200)]  # many near copies of one text, few of each other
    for _ in range(n_copies):
        t = list(centre)
        for _ in range(rng.randint(1, 10)):
            t[rng.randrange(len(t))] = word(9000)
        add(" ".join(t))
    passage = [word(9000) for _ in range(60)]  # a passage that unlike texts share
    for _ in range(60):
        add(" ".join([word(9000) for _ in range(90)] + passage))
    for _ in range(30):
        add("The  SAME text, always")
    add(None), add(""), add(" \n"), add("One"), add("one"), add("A b"), add("a B c")
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = corpus(random.Random(11), 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    want = brute_docs(rows)
    assert len(got) == len(rows)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(dict(rows)[d])) and r.kept == (d == r.component_id) for d, r in got.items())


def check_docs(spark, rows):
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_docs(rows)


def test_star_of_short_texts(spark):
    rows = []
    for n in (5, 6, 8):  # copies link with their base only, which has the lowest id
        base = " ".join(f"s{n}x{i}" for i in range(n))
        rows += [(1000 * n, base)] + [(1000 * n + k, f"{base} t{n}y{k}") for k in range(1, 201)]
    check_docs(spark, rows)


def test_families_without_their_base(spark):
    rng = random.Random(17)
    rows = []
    for n, edits, copies in ((20, (1, 1), 400), (100, (2, 5), 400)):
        base = [f"f{n}x{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(*edits)):
                t[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    check_docs(spark, rows)


def test_near_duplicates_odd_ids(spark):
    long = " ".join(f"x{i}" for i in range(50))
    rows = [(5, "a b c"), (5, long), (9, "a b c"), (7, long), (None, "a b c"), (None, None), (3, "")]
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (7, 5, False), (None, None, True), (None, None, True), (3, 3, True)], key=str)
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(12)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r.id: r.component for r in linking.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups({x for p in pairs for x in p}, pairs)
    assert got == {i: c for i, c in want.items() if i in got}
    assert {i for i in want if want[i] != i} <= set(got)


@pytest.mark.parametrize("heavy, held, expected", [(False, 1 << 23, 1), (True, 1 << 23, 1 << 24), (False, 25, 1)])
def test_groups_are_split_right(spark, monkeypatch, heavy, held, expected):
    rng = random.Random(13)
    rows = [(k, i) for k in range(40) for i in range(rng.choice([1, 2, 3, 16, 17, 60]))]
    rows += [r for r in rows if rng.random() < 0.3]
    spread = lambda k: int(linking._mix(np.array([k], np.uint64)).view(np.int64)[0])
    rows = [(spread(k), i) for k, i in rows]
    if heavy:  # some keys are known to be large beforehand
        monkeypatch.setattr(linking, "heavy_keys", lambda source, keys: [r.key for r in source.groupBy("key").count().where("count > 40").collect()])
    monkeypatch.setattr(linking, "HELD", held)
    monkeypatch.setattr(linking, "PACKED", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        pairs, large = linking.grouped(spark.createDataFrame(rows, "key long, id long"), lambda batches: batches, expected)
        pairs, large = {(r.a, r.b) for r in pairs.collect()}, {(r.family, r.id) for r in large.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    members, size, family = {}, {}, {}
    for k, i in rows:
        members.setdefault(k, set()).add(i)
        size[k] = size.get(k, 0) + 1
    for f, i in large:
        family.setdefault(f, set()).add(i)
    inside = lambda m: any(m <= f for f in family.values())
    assert all(inside(m) for m in members.values() if len(m) > linking.SMALL)  # a large group is in one family
    few = {(a, b) for k, m in members.items() if size[k] <= linking.SMALL for a in m for b in m if a < b}
    if held == 25:  # buckets in parts: small groups may be families, too
        few = {p for p in few if not any(set(p) <= f for f in family.values())}
    between = {(a, b) for k, m in members.items() if linking.SMALL < size[k] and len(m) <= linking.SMALL for a in m for b in m if a < b}
    assert few <= pairs  # repeated rows may make a group large
    partners = {x for p in pairs for x in p}
    assert {i for m in members.values() if len(m) > 1 for i in m} <= partners
    together = {(a, b) for m in [*members.values(), *family.values()] for a in m for b in m if a < b}
    assert pairs <= together and len(pairs - few - between) <= 3 * len(partners)


def test_heavy_keys_are_found_in_a_sample(spark):
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, 7, id) AS key", "id")
    assert linking.heavy_keys(rows, lambda batches: batches) == [7]
    assert linking.heavy_keys(rows.limit(0), lambda batches: batches) == []


@pytest.mark.parametrize("members", [20, 40, 200])
def test_families_of_short_confusable_texts(spark, members):
    """Families in which every pair has 9 of 11 shingles, most of which no two members share a run with."""
    rows = []
    for f in range(32 if members < 100 else 8):
        base = [f"v{f}x{i}" for i in range(11)]
        rows += [(1000 * f + k, " ".join([*base, f"e{f}y{k}"])) for k in range(members)]
    random.Random(3).shuffle(rows)
    check_docs(spark, rows)


def test_recall_beyond_the_sketch():
    """Pairs of large sets at 0.8 to 0.83: share with a common run, by a count of them (the miss at exactly 0.8 is 4e-5)."""
    rng = random.Random(20)
    found = total = 0
    for _ in range(3000):
        n = rng.randint(60, 900)
        both = [rng.getrandbits(64) for _ in range(n)]
        lost = round(n * rng.uniform(0.105, 0.111))
        a, b = both + [rng.getrandbits(64) for _ in range(lost)], both + [rng.getrandbits(64) for _ in range(lost)]
        if 100 * n >= 80 * (n + 2 * lost):
            total += 1
            x, y = (near_dedup.run_keys(np.sort(np.array(s, np.uint64))[: near_dedup.K], near_dedup.RUN, 0) for s in (a, b))
            found += bool(len(np.intersect1d(x, y)))
    assert total > 2000 and found >= total - 2


def test_pipeline_stage_has_shingles_of_five_words(spark):
    import corpus_pipeline

    base = [f"p{i}" for i in range(100)]
    one, three = list(base), list(base)
    one[50] = "q"  # 0.90 on five words
    for i in (20, 50, 80):
        three[i] = f"r{i}"  # 0.89 on two words, 0.73 on five
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(one)), (3, " ".join(three))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [1, 3]


# ---- lines


def brute_lines(rows):
    where = {}
    for d, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for i, s in ((i, line_dedup.string(b)) for i, b in line_dedup.lines_of(t.encode())):
            where.setdefault(s, []).append((d, i))
    lines = sorted(where)
    up = groups(range(len(lines)), [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if line_dedup.similar(lines[a], lines[b])])
    gone = set()
    comps = {}
    for k, s in enumerate(lines):
        comps.setdefault(up[k], []).extend(where[s])
    for places in comps.values():
        gone |= set(places) - {min(places)}
    return {(d, t): t if t is None or d is None else "\n".join(s for i, s in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(14)
    syllable = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ou", "ti"]
    word = lambda: "".join(rng.choice(syllable) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    pool = [line(rng.choice([1, 2, 5, 12, 30])) for _ in range(40)]
    centre = line(40)

    def near(s, edits):
        w = s.split(" ")
        for _ in range(edits):
            w[rng.randrange(len(w))] = word()
        return " ".join(w)

    rows = []
    for d in range(60):
        parts = [rng.choice([rng.choice(pool), near(rng.choice(pool), 1), line(12), "", "  ", near(centre, rng.randint(0, 2))]) for _ in range(rng.randint(1, 8))]
        rows.append((d, "\n".join(parts)))
    rows += [(100, None), (101, ""), (None, pool[0]), (102, "Short"), (103, "short"), (104, "Short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit("clash")).withColumn("packed", F.lit(1))
    out = line_dedup.clean(docs)
    assert out.columns == docs.columns
    got, want = out.collect(), brute_lines(rows)
    assert len(got) == len(rows)
    left = {r.doc_id: r.text for r in got if r.doc_id is not None}
    wrong = [(d, t) for (d, t) in want if d is not None and left[d] != want[(d, t)]]
    assert not wrong
    assert [r.text for r in got if r.doc_id is None] == [pool[0]]
    assert line_dedup.clean(docs.limit(0)).count() == 0


def test_line_goes_only_from_its_own_text(spark):
    rows = [(1, "a line that comes again"), (2, "words of one text\na line that comes again"), (2, "another text\nwith a line of its own")]
    got = [r.text for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted([rows[0][1], "words of one text", rows[2][1]])


def test_line_family_without_its_base(spark):
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    base = [word() for _ in range(20)]
    rows = []
    for d in range(400):
        t = list(base)
        t[rng.randrange(20)] = word()
        rows.append((d, " ".join(t)))
    left = {r.doc_id: r.text for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lines, keys = [t for _, t in rows], line_dedup.band_keys([t for _, t in rows])
    links = [(a, b) for a in range(400) for b in range(a + 1, 400) if line_dedup.similar(lines[a], lines[b])]
    every, listed = groups(range(400), links), groups(range(400), [(a, b) for a, b in links if (keys[a] == keys[b]).any()])
    # links of lines that share a band must all be found; a line that shares none may be reached or not
    assert not [d for d in range(400) if listed[d] != d and left[d] or every[d] == d and not left[d]]
    assert sum(listed[d] != every[d] for d in range(400)) < 5


def test_exact_codes_agree_with_sets():
    rng = random.Random(16)
    lines = ["".join(rng.choice("abcé" + ("日" if rng.random() < 0.1 else "")) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    others = [s if rng.random() < 0.3 else s[: rng.randint(0, 6)] + s[1:] if rng.random() < 0.7 else rng.choice(lines) for s in lines]
    assert line_dedup.all_similar(lines, others) == [i for i, (x, y) in enumerate(zip(lines, others)) if line_dedup.similar(x, y)]


def test_line_recall_is_high():
    rng = random.Random(15)
    found = total = 0
    for _ in range(300):
        a = "".join(rng.choice("abcdefghij ") for _ in range(120))
        b = list(a)
        b[rng.randrange(20, 100)] = "#"
        b = "".join(b)
        if line_dedup.similar(a, b):
            total += 1
            k = line_dedup.band_keys([a, b])
            found += bool((k[0] == k[1]).any())
    assert total > 250 and found / total > 0.99


@pytest.mark.parametrize("text", ["", "a", "one two", "x " * 500])
def test_shingler_counts(text):
    assert len(near_dedup.Shingler().hashes(text)) == len(shingles(text))


def test_pairs_are_verified_in_rounds(spark):
    """What a round brings along does not grow with the number of pairs, and no link is lost."""
    pairs = linking.saved(spark.range(1000).selectExpr("id AS a", "id + 7 AS b"))
    sizes = []

    def verify(some):
        sizes.append(some.count())
        return some.where("a % 3 = 0")

    links = linking.verified(pairs, verify, 100)
    assert len(sizes) == 10 and sum(sizes) == 1000 and max(sizes) < 200
    assert sorted(r.a for r in links.collect()) == list(range(0, 1000, 3))


def test_few_edges_need_no_exchange(spark, monkeypatch):
    plans, real = [], linking.saved

    def saved(df, instead=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, instead)

    monkeypatch.setattr(linking, "saved", saved)
    pairs = linking.saved(spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long"))
    del plans[:]
    assert {r.component for r in linking.components(pairs).collect()} == {0}
    assert len(plans) > 2 and not any("hashpartitioning" in p for p in plans[1:])  # the first makes the pairs distinct


def test_signature_of_a_line_is_its_own():
    lines = ["a", "b", "c", "abcdefg", "hello world", "q", "abcdefghij" * 5, "\U0001f600", "日本" * 9]
    together = line_dedup.signatures(lines)
    assert all((line_dedup.signatures([s])[0] == row).all() for s, row in zip(lines, together))


def test_what_differs_too_much_is_seen_before_shingles_are_sorted():
    rng = random.Random(6)
    a = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(40)]
    b = [s[: 300 - k * 4] + "".join(rng.choice("ijkl") for _ in range(k * 4)) for k, s in enumerate(a)]
    may = line_dedup._may_be_similar(a + b, np.arange(40), np.arange(40, 80))
    same = [line_dedup.similar(x, y) for x, y in zip(a, b)]
    assert all(may[k] for k in range(40) if same[k]) and 0 < sum(same) <= sum(may) < 20


def test_similar_pairs_of_odd_lines():
    rng = random.Random(5)
    lines = ["a", "abcdefg", "abcdefgh", "\U0001f600" * 9, "abcdefg" * 3, "日本" * 9, "x" * 700] + ["".join(chr(rng.randrange(1, 3000)) for _ in range(900)) for _ in range(2)]
    left, right = zip(*[(a, b) for a in lines for b in [*lines, lines[-1][:850] + "!"]])
    assert line_dedup.all_similar(list(left), list(right)) == [i for i, (a, b) in enumerate(zip(left, right)) if line_dedup.similar(a, b)]


def test_a_pair_meets_once_for_shingles_in_a_row():
    """Members of one list that share many shingles one after another meet at the first, and no pair is lost; lists are short and long."""
    rng = np.random.default_rng(4)
    common = rng.integers(-(1 << 62), 1 << 62, 60)
    for members in (3, 40):
        sets = [np.sort(np.append(common, rng.integers(-(1 << 62), 1 << 62, 5)).view(np.uint64)).view(np.int64) for _ in range(members)]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.arange(members)), pa.array(np.arange(members) // 2), pa.array(sets, pa.list_(pa.int64()))], names=["id", "component", "hashes"])
        counts = np.zeros(linking.BUCKETS, np.uint32)
        np.add.at(counts, (np.concatenate(sets).view(np.uint64) % np.uint64(linking.BUCKETS)).astype(np.int64), np.uint32(1))
        rows = pa.Table.from_batches(list(linking._prefixes(counts)(iter([batch])))).sort_by("key")
        met = [(a, b) for out in linking._met(iter(rows.to_batches(max_chunksize=50))) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
        want = {(a, b) for a in range(members) for b in range(a + 1, members) if a // 2 != b // 2}
        assert set(met) == want
        assert len(met) == len(want)
