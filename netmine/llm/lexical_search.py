"""Ranked lexical search: MaxScore over an inverted index in shards.

`build` reads every document once and writes the index as a table: a shard is a run
of documents of one task, up to a number of postings, and a row is one term of one
shard with its documents and frequencies.  A search joins the index with the terms
asked for, so other postings and columns are not read, and runs MaxScore in every
shard: lists in order of their upper bounds, the first ones (essential) may bring
new documents; once what is left can't lift an unseen document to the k-th best
score, the rest (non-essential) are probed only for documents that can still
qualify.  Each shard gives at most k documents for an item; Spark keeps the k best
of each task and then of all.

Items go in blocks of a fixed number, each against all shards, so a task holds one
shard's asked postings and the terms of one block, however many items there are.
The index is in the shared folder; a lost executor costs its shards only.

Defined cases: null and empty texts, and texts without a term, are no documents; an
item without terms, or whose terms no document holds, has no rows; rows with one
doc_id are documents of their own, in any order among equals; a null doc_id comes
last among equal scores; items with one item_id are one item with all their terms;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netmine.llm.common import delete, pieces, saved
from netmine.operators.order import numbered

K = 10
#: Postings of a shard; one document's are never parted.
SHARD_POSTINGS = 1 << 20
#: Items that one task ranks in one shard.
BLOCK = 1000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes as TERM takes them: beyond ASCII all belong to terms, so splitting bytes splits code points right.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))

#: One row for each term of a shard: local numbers of documents, ascending, and frequencies.  The row without a term holds the shard's ids and lengths.
INDEX = "shard long, term string, n_docs int, docs array<int>, tfs array<int>, ids array<long>, lengths array<int>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


class Shard:
    """Postings as they are read: a number for each term, and flat arrays of term, document and frequency."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.postings = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = terms_of(text)
        if not words:
            return
        held, numbers = Counter(words), self.numbers
        self.terms.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in held), dtype=np.int32, count=len(held)))
        self.tfs.append(np.fromiter(held.values(), dtype=np.int32, count=len(held)))
        self.sizes.append(len(held))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.postings += len(held)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The head, then the terms in parts."""
        if not self.ids:
            return
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        none = pa.array([None], pa.list_(pa.int32()))
        names = ["shard", "term", "n_docs", "docs", "tfs", "ids", "lengths"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([None], pa.string()), pa.array([len(self.ids)], pa.int32()), none, none, lists(self.ids, pa.int64()), lists(self.lengths, pa.int32())], names=names
        )
        terms, tfs = np.concatenate(self.terms), np.concatenate(self.tfs)
        docs = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        order = np.argsort(terms, kind="stable")
        docs, tfs = docs[order], tfs[order]
        ends = np.append(0, np.cumsum(np.bincount(terms, minlength=len(self.numbers)))).astype(np.int32)
        words = list(self.numbers)
        for a in range(0, len(words), 1 << 14):
            b = min(a + (1 << 14), len(words))
            cut = ends[a : b + 1]
            at = pa.array(cut - cut[0], pa.int32())
            part = slice(cut[0], cut[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(b - a, shard), pa.int64()), pa.array([w.decode() for w in words[a:b]], pa.string()), pa.array(np.diff(cut), pa.int32()),
                    pa.ListArray.from_arrays(at, pa.array(docs[part])), pa.ListArray.from_arrays(at, pa.array(tfs[part])),
                    pa.nulls(b - a, pa.list_(pa.int64())), pa.nulls(b - a, pa.list_(pa.int32())),
                ],
                names=names,
            )


class Index(NamedTuple):
    """The written table, the number of documents that hold a term, and the number of all their terms."""

    rows: DataFrame
    documents: int
    terms: int


def build(docs: DataFrame, postings: int = SHARD_POSTINGS) -> Index:
    """Index of every document, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shard, made = TaskContext.get().partitionId() << 32, Shard(), 0
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                shard.add(doc_id, text.as_py() or b"")
                if shard.postings >= postings:
                    yield from shard.rows(first + made)
                    shard, made = Shard(), made + 1
        yield from shard.rows(first + made)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = saved(chosen.mapInArrow(run, INDEX))
    totals = rows.where("term IS NULL").agg(F.sum("n_docs").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    return Index(rows, totals.n or 0, totals.l or 0)


def lengths_factor(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of each document: ten and ninety times its length over the mean one."""
    return 10 + (90 * lengths.astype(np.int64) * documents) // terms


class Postings(NamedTuple):
    docs: np.ndarray
    gains: np.ndarray
    bound: int


def best(lists: list[Postings], acc: np.ndarray, ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Local numbers and scores of the k best documents with a score above 0, equal scores by id; `acc` holds zeros before and after."""
    lists = sorted(lists, key=lambda p: -p.bound)
    rest = np.append(np.cumsum([p.bound for p in lists][::-1])[::-1], 0) if lists else [0]
    least, seen, i = 1, [], 0
    # Essential: a document that no list so far holds could still be among the best (a tie counts, its id may be smaller).
    while i < len(lists) and rest[i] >= least:
        p = lists[i]
        acc[p.docs] += p.gains
        seen.append(p.docs)
        if len(p.docs) >= k:
            held = acc[p.docs]
            least = max(least, int(np.partition(held, len(held) - k)[len(held) - k]))
        i += 1
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.unique(np.concatenate(seen)) if len(seen) > 1 else seen[0]
    scores = acc[found]
    acc[found] = 0
    while True:
        if len(found) >= k:
            least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        can = scores + rest[i] >= least
        found, scores = found[can], scores[can]
        if i >= len(lists):
            break
        p = lists[i]  # non-essential: probed for these documents only
        at = np.minimum(np.searchsorted(p.docs, found), len(p.docs) - 1)
        hit = p.docs[at] == found
        scores[hit] += p.gains[at[hit]]
        i += 1
    order = np.lexsort((found, ids[found], -scores))[:k]
    return found[order], scores[order]


_FOUND = pa.schema([("item_no", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searcher(documents: int, terms: int, k: int):
    """Ranks all items of one block in one shard."""

    def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        whole = column.combine_chunks()
        return whole.offsets.to_numpy(), whole.values.to_numpy(zero_copy_only=False)

    def run(group: pa.Table) -> pa.Table:
        head = group.filter(pc.is_null(group["term"]))
        lists = group.filter(pc.is_valid(group["term"]))
        if not lists.num_rows:
            return _FOUND.empty_table()
        known = head["ids"][0].values
        none = known.is_null().to_numpy(zero_copy_only=False)
        ids = known.fill_null(np.iinfo(np.int64).max).to_numpy()
        m = lengths_factor(head["lengths"][0].values.to_numpy(), documents, terms)
        at, docs = flat(lists["docs"])
        _, tfs = flat(lists["tfs"])
        item_at, items = flat(lists["items"])
        weights = lists["weight"].to_pylist()
        asked: dict[int, list[Postings]] = {}
        for row, weight in enumerate(weights):
            if weight <= 0:
                continue
            which = docs[at[row] : at[row + 1]]
            tf = tfs[at[row] : at[row + 1]].astype(np.int64)
            gains = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[which]))
            p = Postings(which, gains, int(gains.max()))
            for item in items[item_at[row] : item_at[row + 1]].tolist():
                asked.setdefault(item, []).append(p)
        acc = np.zeros(len(ids), dtype=np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for item, held in asked.items():
            found, scores = best(held, acc, ids, k)
            out.append((np.full(len(found), item), found, scores))
        if not out:
            return _FOUND.empty_table()
        item, found, scores = (np.concatenate(c) for c in zip(*out))
        return pa.table([pa.array(item, pa.int64()), pa.array(ids[found], pa.int64(), mask=none[found]), pa.array(scores, pa.int64())], schema=_FOUND)

    return run


def search(index: Index, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank from 1, doc_id, score: the k best documents of each item (item_id, text)."""
    spark = items.sparkSession
    ids = items.select("item_id").distinct()
    listed = saved(numbered(ids, [F.col("item_id").asc_nulls_first()], "item_no"))
    count = listed.count()
    blocks = max(-(-count // block), 1)
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    asked = items.select("item_id", F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    numbered_terms = asked.join(listed, asked.item_id.eqNullSafe(listed.item_id)).select("item_no", "term")
    by_block = numbered_terms.groupBy(F.expr(f"item_no div {block}").alias("block"), "term").agg(F.collect_list("item_no").alias("items"))  # at most `block` of them
    by_block = saved(by_block)
    frequencies = index.rows.select("term", "n_docs").join(by_block.select("term").distinct(), "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * index.documents + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighed = saved(by_block.join(frequencies.select("term", weight.alias("weight")), "term"), instead=by_block)
    lists = index.rows.where("term IS NOT NULL").select("shard", "term", "docs", "tfs").join(weighed, "term")
    none = lambda kind: F.lit(None).cast(kind)
    heads = index.rows.where("term IS NULL").select(
        "shard", none("string").alias("term"), none("array<int>").alias("docs"), none("array<int>").alias("tfs"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"),
        none("array<bigint>").alias("items"), none("long").alias("weight"), "ids", "lengths",
    )
    both = lists.select("shard", "term", "docs", "tfs", "block", "items", "weight", none("array<bigint>").alias("ids"), none("array<int>").alias("lengths")).unionByName(heads)
    found = both.groupBy("shard", "block").applyInArrow(_searcher(index.documents, max(index.terms, 1), k), "item_no long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())).alias("rank")
    top = saved(found.select("*", place).where(F.col("rank") <= k))  # a few rows for each item
    out = top.join(listed, "item_no").select("item_id", "rank", "doc_id", "score")
    delete(spark, weighed._saved_at)
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Index and search in one; the index is deleted."""
    index = build(docs)
    out = search(index, items, k)
    delete(docs.sparkSession, index.rows._saved_at)
    return out


def oracle(k: int = K) -> str:
    """Every document against every item, without bounds."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
t AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t, s GROUP BY term, n),
g AS (SELECT t.r, term, f.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * CAST(len(d.w) AS BIGINT) * s.n) // s.l))) AS gain FROM t JOIN f USING (term) JOIN d ON d.r = t.r, s),
p AS (SELECT q.item_id, r, CAST(sum(gain) AS BIGINT) AS score FROM q JOIN g USING (term) GROUP BY q.item_id, r),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {k}"""
