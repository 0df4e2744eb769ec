"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the distinct shingles of `size` words, two in op8 (A-Z lower-cased, words
are `[^\\x20\\x09-\\x0D]+`); with fewer words, the whole sequence is the one shingle.
Equal sets are one class.  The sketch is the K smallest hashes of a set.  The
inverted lists are those of runs of RUN neighbouring retained values: every
run that two sketches share puts both documents into one list.  Two sets with
Jaccard >= 0.8 and a union of over 15 shingles always share a run of four when
the sketches hold the whole sets (four fifths of the values cannot be cut into
runs of three by the other fifth); small sets are also listed by runs of two,
which is complete for any union; for larger sets a run is missed with
probability 0.8**K at 0.8.  Lists longer than linking.SMALL give the pairs with
their leaders, and what those leave open is joined exactly on the full sets
(linking.link).  The union-sketch estimate drops pairs far below 0.8, and the
rest is confirmed on the full sets, made again from the texts, which travel
compressed.

Defined cases: null and empty texts have the empty set and link with nothing;
null doc_id links with nothing, its component is null and it is kept; rows
that share a doc_id are one node with all their texts, so they are kept
together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmine.llm import linking
from netmine.llm.common import pieces, saved

K = 48
RUN = 4
SMALL_SET = 20
#: A document is paired with so many leaders first: most of their pairs fail the estimate, which is cheap.
LEADERS = 12
#: Five standard deviations below 0.8 of the share of K union values in both sketches.
ESTIMATE = 0.5
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hash sets of texts; words' hashes are cached up to a bound."""

    CACHE = 1 << 16

    def __init__(self, size: int = 2):
        self.size, self.cache = size, {}

    def words(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        cache = self.cache
        try:
            return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(cache) > self.CACHE:
                cache.clear()
            for w in set(words):
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))

    def hashes(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        w = self.words(text)
        if not len(w):
            return w
        n = min(self.size, len(w))
        h = np.full(len(w) - n + 1, np.uint64(n))
        for k in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
        return np.unique(h)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _sketches(batches, size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))])
    shingler = Shingler(size)
    for batch in pieces(batches):
        n, digests, sketches = [], [], []
        for t in batch.column("text").to_pylist():
            s = shingler.hashes(t or "")
            n.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketches.append(s[:K].view(np.int64).copy())  # a view would hold the whole set
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], schema=schema
        )


def run_keys(sketch: np.ndarray, run: int, seed: int) -> np.ndarray:
    """Hashes of all runs of neighbouring values."""
    n = len(sketch) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(seed * 1000 + run))
    for k in range(run):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sketch[k : k + n])
    return h


def _keys(batches):
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])
    for batch in pieces(batches, 2048):
        out, who = [], []
        sketches = batch.column("sketch")
        flat, offsets = sketches.flatten().to_numpy().view(np.uint64), sketches.offsets.to_numpy()
        offsets = offsets - offsets[0]
        for i, (rep, n) in enumerate(zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist())):
            s = flat[offsets[i] : offsets[i + 1]]
            h = run_keys(s, RUN, 0)
            if n <= SMALL_SET:
                h = np.append(h, run_keys(s, 2, 1))
            out.append(h)
            who.append(np.full(len(h), rep, np.int64))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(who))], schema=schema)


def _packed(batches):
    schema = pa.schema([("id", pa.int64()), ("packed", pa.binary())])
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in pieces(batches):
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())], schema=schema)


def _full(batches, size: int):
    schema = pa.schema([("id", pa.int64()), ("hashes", pa.list_(pa.int64()))])
    unpack, shingler = zstandard.ZstdDecompressor().decompress, Shingler(size)
    for batch in pieces(batches):
        sets = [shingler.hashes(unpack(p).decode("utf-8", "surrogatepass")).view(np.int64) for p in batch.column("packed").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], schema=schema)


def _confirmed(batches, size: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    unpack, shingler = zstandard.ZstdDecompressor().decompress, Shingler(size)
    kept, last = None, None
    for batch in pieces(batches):
        keep = []
        for p, q in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist()):
            if q != last:  # rows come sorted by b
                last, kept = q, shingler.hashes(unpack(q).decode("utf-8", "surrogatepass"))
            keep.append(jaccard_at_least(shingler.hashes(unpack(p).decode("utf-8", "surrogatepass")), kept))
        at = pa.array(np.flatnonzero(keep), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], schema=schema)


def near_duplicates(docs: DataFrame, size: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; shingles have `size` words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = saved(rows.mapInArrow(partial(_sketches, size=size), "doc_id long, n long, digest binary, sketch array<long>"))
    sets = base.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = saved(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch")))
    reps = classes.select("digest", "rep")
    member = sets.select("doc_id", "digest").join(reps, "digest").select("doc_id", "rep")
    # a doc_id with several texts ties their classes together
    several = sets.groupBy("doc_id").agg(F.countDistinct("digest").alias("k")).where("k > 1").select("doc_id")
    ties = member.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    held: dict[str, DataFrame] = {}

    def prepare(ids):
        needed = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumnRenamed("doc_id", "id").select("id", "text")
        held["texts"] = saved(needed.mapInArrow(_packed, "id long, packed binary").join(ids.hint("merge"), "id", "left_semi"))

    def verify(pairs):
        side = classes.select("rep", "n", "sketch")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
        near = (
            pairs.join(side.toDF("a", "na", "sa"), "a").where("na > 0")
            .join(side.toDF("b", "nb", "sb"), "b")
            .where("100 * least(na, nb) >= 80 * greatest(na, nb)")
            .withColumn("u", union)
            .where(F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")) >= ESTIMATE * F.size("u"))
            .select("a", "b").distinct()
        )
        texts = held["texts"]
        # texts are never few: joins by shuffle, sorted by b, at any size
        full = near.join(texts.toDF("a", "pa").hint("merge"), "a").join(texts.toDF("b", "pb").hint("merge"), "b").select("a", "b", "pa", "pb")
        return full.mapInArrow(partial(_confirmed, size=size), "a long, b long")

    def full(ids):
        return held["texts"].join(ids, "id", "left_semi").mapInArrow(partial(_full, size=size), "id long, hashes array<long>")

    source = classes.select("rep", "n", "sketch")
    found = linking.link(source, _keys, K * source.count(), prepare, verify, full, most=LEADERS)
    # links between classes, and ties by doc_id, make the components
    if not several.isEmpty():
        found = linking.components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(ties))
    of_class = classes.select("digest", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component")
    )
    return base.select("doc_id", "n", "digest").join(of_class, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
