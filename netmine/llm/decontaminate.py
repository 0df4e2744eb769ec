"""Benchmark decontamination with an FM-index per shard of the training text.

A shard is a run of documents of one task.  Its words are numbered by the
benchmark's vocabulary, and stretches that hold no two neighbouring words of the
benchmark's word pairs (nor a one-word item) are left out: no window can lie
there.  Over the rest the shard builds suffix order, the transform's wavelet
matrix and sampled suffix positions; all windows are searched backwards at
once, their rows are located by walking to a sample, and the hit words of a
document are merged into removal spans.

Words: A-Z lower-cased `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.  A window is WINDOW consecutive
words of an item, or the whole item if it is shorter.  Defined cases: null and
empty texts have no words; items without words are never found; items with
equal texts are all reported; repeated rows are judged alike; null item_ids are
not reported but their windows count as hits; empty tables give no rows or no
hits; other columns are kept by `clean` and ignored by `find`.

The benchmark goes to the executors in parts of at most PART_WORDS words, one after
another, so its broadcast has a bound whatever its size: documents that have met a
part are written with the words hit and items found so far before the next is sent.
An item longer than a part is cut with as much overlap as a window needs.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netmine.llm.common import pieces, saved

WINDOW = 10
PART_WORDS = 2_000_000
SHARD_WORDS = 1 << 20
SAMPLE = 8
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Lower-cases A-Z and turns every other ASCII code point that is no digit or letter into a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Windows:
    """The windows of some items as rows of word numbers (from 1), and the items of each."""

    def __init__(self, items: list[tuple[object, list[bytes]]], size: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list] = {}
        number = self.vocabulary
        for item, words in items:
            ids = [number.setdefault(w, len(number) + 1) for w in words]
            n = min(size, len(ids))
            for window in dict.fromkeys(tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)) if n else ():
                owners.setdefault(window, []).append(item)
        self.windows = list(owners)
        self.items = list(owners.values())
        self.lengths = np.array([len(w) for w in self.windows], dtype=np.int64)
        most = int(self.lengths.max(initial=1))
        self.matrix = np.zeros((len(self.windows), most), dtype=np.int64)  # right-aligned
        for i, w in enumerate(self.windows):
            self.matrix[i, most - len(w) :] = w
        self.base = len(number) + 1
        pairs = {a * self.base + b for w in self.windows for a, b in zip(w, w[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.single = np.zeros(self.base, dtype=bool)
        self.single[[w[0] for w in self.windows if len(w) == 1]] = True
        self.shortest = min((len(w) for w in self.windows if len(w) > 1), default=most)


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit row and its running count for each level."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.append(0, np.cumsum(bit)).astype(np.int64))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros_like(at), at
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            ones, zeros = self.ones[k], self.zeros[k]
            l1, h1 = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + l1, lo - l1), np.where(bit, zeros + h1, hi - h1)
        return hi - lo


class FMIndex:
    """Over symbols 1.. in stretches that 0 ends; every 0 differs from every other."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends) - 1
        rank[ends] = np.arange(len(ends))
        order, step = np.argsort(rank, kind="stable"), 1
        rank = self._ranks(rank[order], order)
        open_ = n
        while open_ > 1 and step < 2 * n:
            key = rank * np.int64(n + 1)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            rank = self._ranks(key[order], order)
            step *= 2
            open_ = n - (int(rank.max(initial=0)) + 1) + 1
        self.last = text[order - 1]  # text[-1] is a 0
        self.tree = WaveletMatrix(self.last, n_symbols)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=n_symbols)))
        begins = np.append(True, text[:-1] == 0) if n else np.zeros(0, bool)
        self.sampled = (order % SAMPLE == 0) | begins[order]
        self.place = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]
        self.n = n

    @staticmethod
    def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys), dtype=np.int64)
        out[order] = np.cumsum(np.append(0, keys[1:] != keys[:-1])) if len(keys) else 0
        return out

    def search(self, matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one row of every right-aligned pattern, all backwards together."""
        lo, hi = np.zeros(len(matrix), dtype=np.int64), np.full(len(matrix), self.n, dtype=np.int64)
        alive = np.arange(len(matrix))
        for k in range(matrix.shape[1]):
            alive = alive[(lengths[alive] > k) & (hi[alive] > lo[alive])]
            if not len(alive):
                break
            c = matrix[alive, matrix.shape[1] - 1 - k]
            lo[alive], hi[alive] = self.first[c] + self.tree.rank(c, lo[alive]), self.first[c] + self.tree.rank(c, hi[alive])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps to the left until a sampled row."""
        out = np.empty(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.positions[self.place[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            c = self.last[at]
            at = self.first[c] + self.tree.rank(c, at)
            steps += 1
        return out


def find_in_shard(windows: Windows, docs: list[list[bytes]]) -> tuple[list[np.ndarray], list[set]]:
    """For each document the hit flags of its words, and the items found in it."""
    sizes = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    found: list[set] = [set() for _ in docs]
    if not total or not len(windows.windows):
        return [np.zeros(n, dtype=bool) for n in sizes], found
    get = windows.vocabulary.get
    ids = np.fromiter(map(get, chain.from_iterable(docs), repeat(0)), dtype=np.int64, count=total)
    owner = np.repeat(np.arange(len(docs)), sizes)
    joined = np.zeros(total, dtype=bool)  # this word and the next are a pair of some window
    both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & (owner[:-1] == owner[1:]))
    if len(windows.pairs) and len(both):
        pair = ids[both] * windows.base + ids[both + 1]
        at = np.minimum(np.searchsorted(windows.pairs, pair), len(windows.pairs) - 1)
        joined[both[windows.pairs[at] == pair]] = True
    # stretches of joined words, those long enough for a window
    begin = np.flatnonzero(joined & ~np.append(False, joined[:-1]))
    end = np.flatnonzero(joined & ~np.append(joined[1:], False)) + 2
    long_enough = end - begin >= windows.shortest
    begin, end = begin[long_enough], end[long_enough]
    alone = np.flatnonzero(windows.single[ids])
    begin, end = np.append(begin, alone), np.append(end, alone + 1)
    if not len(begin):
        return [np.zeros(n, dtype=bool) for n in sizes], found
    length = end - begin + 1
    upto = np.cumsum(length) - length
    source = np.repeat(begin - upto, length) + np.arange(int(length.sum()))
    stop = upto + length - 1
    text = ids[np.minimum(source, total - 1)]
    text[stop] = 0
    symbols = np.unique(text[text > 0])  # the shard's own alphabet
    text = np.where(text > 0, np.searchsorted(symbols, text) + 1, 0)
    place = np.searchsorted(symbols, windows.matrix)
    known = symbols[np.minimum(place, len(symbols) - 1)] == windows.matrix
    possible = np.flatnonzero((known | (windows.matrix == 0)).all(axis=1))
    index = FMIndex(text, len(symbols) + 1)
    lo, hi = index.search((place + 1)[possible], windows.lengths[possible])
    count = hi - lo
    which = np.repeat(possible, count)
    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    where = source[index.locate(rows)]
    edge = np.bincount(where, minlength=total + 1) - np.bincount(where + windows.lengths[which], minlength=total + 1)
    hit = np.cumsum(edge[:-1]) > 0
    seen = np.unique(np.stack([owner[where], which]), axis=1) if len(where) else np.zeros((2, 0), np.int64)
    for d, w in zip(*seen.tolist()):
        found[d].update(windows.items[w])
    return [hit[a : a + n] for a, n in zip(first, sizes)], found


def _parts(benchmark: DataFrame):
    """The benchmark's windows, a bounded part at a time."""
    part, held = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        words = words_of(row.text)
        for at in range(0, max(1, len(words) - WINDOW + 1), PART_WORDS):
            piece = words[at : at + PART_WORDS + WINDOW - 1]
            if part and held + len(piece) > PART_WORDS:
                yield Windows(part)
                part, held = [], 0
            part.append((row.item_id, piece))
            held += len(piece)
    yield Windows(part)


def _shards(texts: list[str | None]):
    """Runs of documents of about SHARD_WORDS words."""
    docs, held, first = [], 0, 0
    for i, t in enumerate(texts):
        docs.append(words_of(t))
        held += len(docs[-1])
        if held >= SHARD_WORDS:
            yield first, docs
            docs, held, first = [], 0, i + 1
    if docs:
        yield first, docs


def _met(windows, at: int, first: bool, finish):
    """Rows with the words hit (bits) and items found, joined to those of earlier parts, and then what `finish` makes of them."""
    def run(batches):
        for batch in pieces(batches, 1024):
            texts = batch.column(at).to_pylist()
            own = batch.columns if first else batch.columns[:-2]
            before = None if first else [batch.column(len(own) + k).to_pylist() for k in (0, 1)]
            hits, items = [], []
            for start, docs in _shards(texts):
                for k, (hit, found) in enumerate(zip(*find_in_shard(windows.value, docs))):
                    names = {str(x) for x in found if x is not None}
                    if before:
                        hit = hit | np.unpackbits(np.frombuffer(before[0][start + k], np.uint8), count=len(hit)).astype(bool)
                        names |= set(before[1][start + k])
                    hits.append(hit)
                    items.append(sorted(names))
            if texts:
                yield finish(own, texts, hits, items)

    return run


def _kept(own, texts, hits, items):
    """For the parts that follow: the columns, the bits and the items."""
    columns = [*own, pa.array([np.packbits(h).tobytes() for h in hits], pa.binary()), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(own))] + ["hit", "items"])


def marked(spark: SparkSession, rows: DataFrame, at: int, benchmark: DataFrame, finish, ddl: str) -> DataFrame:
    """What `finish` (with schema `ddl`) makes of rows c0, c1, ..., the words hit in the text at column `at`, and the items found, over all parts."""
    between = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", hit binary, items array<string>"
    parts = _parts(benchmark)
    now, after, first = next(parts), next(parts, None), True
    while after is not None:
        shared = spark.sparkContext.broadcast(now)
        rows = saved(rows.mapInArrow(_met(shared, at, first, _kept), between))
        shared.destroy()
        now, after, first = after, next(parts, None), False
    return rows.mapInArrow(_met(spark.sparkContext.broadcast(now), at, first, finish), ddl)


def removal_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code points from the first to the last word of every stretch of hit words."""
    spans, last = [], -2
    for i, m in enumerate(WORD.finditer(text.translate(_LOWER))):  # one code point for one
        if hit[i]:
            if last == i - 1:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
            last = i
    return [tuple(s) for s in spans]


FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: long, end: long>>"


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document, with the merged removal spans."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", span)]
    )

    def finish(own, texts, hits, items):
        rows = []
        for text, hit, names in zip(texts, hits, items):
            n = int(hit.sum())
            rows.append((len(hit), n, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n > 0,
                         [{"start": a, "end": b} for a, b in removal_spans(text, hit)] if n else []))
        return pa.RecordBatch.from_arrays([own[0]] + [pa.array(c, type=f.type) for c, f in zip(zip(*rows), list(schema)[1:])], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("c0"), F.col("text").cast("string").alias("c1"))
    return marked(spark, texts, 1, benchmark, finish, FOUND)


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with all benchmark spans cut out of their texts; other columns stay, a null text stays null."""
    at = docs.columns.index("text")

    def finish(own, texts, hits, items):
        for i, hit in enumerate(hits):
            if hit.any():
                kept, last = [], 0
                for start, end in removal_spans(texts[i], hit):
                    kept.append(texts[i][last:start])
                    last = end
                texts[i] = "".join(kept) + texts[i][last:]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(own)], names=[f"c{k}" for k in range(len(own))])

    # numbered names: extra columns may clash
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(numbered.schema))
    return marked(spark, numbered, at, benchmark, finish, kinds).toDF(*docs.columns)
