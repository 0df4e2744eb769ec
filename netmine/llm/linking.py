"""Links between sets that share a key, without all pairs of a large group, and their components.

`link` gets (key, id) rows.  A group of at most SMALL ids gives all its pairs.  A
larger one belongs to a family, which groups of the same near copies mostly share.  A
family has a few leaders, those ids that are in most large groups, and every id is
paired with the foremost of its leaders.  That is only the order of work: the members
of every large group that is still in several components are joined exactly on their full sets, by prefixes in which rare
shingles come first, and only pairs from different components are verified.  So no
link between two ids that share a key is lost.  No group is collected: keys travel in
sorted runs of neighbouring ones, and a task holds at most HELD of them, or two blocks
of about BLOCK.  Keys that a sample shows to hold a large part of all rows are large
groups for certain; their rows are dealt out by id instead of meeting in one task.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netmine.llm.common import pieces, saved

SMALL = 16
#: Leaders of a family.  An id is paired with a few of its families' first; what they leave apart goes to the exact join.
LEADERS = 3
#: Pairs (16 bytes each) that are held to be sorted and cut into buckets, that a bucket has about, and that are held of one.
PACKED, BUCKET, HELD = 1 << 20, 1 << 15, 1 << 23
#: Buckets are at most so many, as a power of two.
MOST_BITS = 18
#: The exact join: links have at least this Jaccard similarity.
PERCENT = 80
#: Shingles are counted in so many classes (four bytes each); any counts give a right order, true ones give short lists.
BUCKETS = 1 << 22
#: Counts travel in so many parts.
CHUNKS = 256
#: A list of more members is dealt out as pairs of blocks of about so many.
BLOCK = 512
#: Pairs of a list's members that are looked at at once.
CELLS = 1 << 18
#: Edges (16 bytes each) that one task may hold while components are made; more are dealt out.
ONE_TASK = 500_000
#: Pairs that are verified at once, as a share of the keys, and at least: what is fetched for them is on disk only that long.
PAIRS_OF_KEYS, PAIRS = 64, 1 << 20
#: Share of the rows that is sampled to find keys of large groups, and the least number of them in the sample.
SAMPLED, HEAVY = 0.01, 64
#: A heavy key has at least one in so many of the sampled rows, which bounds the number of heavy keys.
ONE_IN = 4000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def release(spark: SparkSession) -> None:
    """Let the driver drop what nothing refers to any more, so that executors delete old shuffle files."""
    for _ in range(2):  # what Python drops reaches the JVM a little later
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Groups:
    """Batches of what _split finds: pairs (a, b), their family null, and members of large groups: family and id (a)."""

    schema = pa.schema([("family", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def pairs(self, keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, keys))
        k, i = keys[order], ids[order]
        fresh = np.append(True, (k[1:] != k[:-1]) | (i[1:] != i[:-1])) if len(k) else np.zeros(0, bool)
        k, i = k[fresh], i[fresh]
        left, right = [_NONE], [_NONE]
        for d in range(1, SMALL):
            at = np.flatnonzero(k[d:] == k[:-d])
            if not len(at):
                break
            left.append(i[at])
            right.append(i[at + d])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], schema=self.schema)

    def large(self, keys: np.ndarray, ids: np.ndarray, parted: bool = False) -> pa.RecordBatch:
        """Members of groups.  The family of a whole group is its least id, so groups of the same near copies are
        mostly one family; that of a group in parts is its key.
        """
        family = keys
        if not parted:
            at = np.argsort(keys)
            keys, ids = keys[at], ids[at]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            family = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, len(keys))))
        return pa.RecordBatch.from_arrays([pa.array(family), pa.array(ids), pa.nulls(len(ids), pa.int64())], schema=self.schema)


_NONE = np.zeros(0, np.int64)


def _dealt(keys, bits: int, heavy: np.ndarray):
    """From batches (key, id) of `keys` to rows (bucket, packed): many pairs cut into buckets of neighbouring keys.

    Heavy keys are dealt out by id.  A row of some hundred pairs costs the shuffle what a row of one pair would.
    """
    schema = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
    shift = np.uint64(64 - bits) if bits else None

    def flush(parts):
        k, i = (np.concatenate(x) for x in zip(*parts))
        place = k.view(np.uint64)
        if len(heavy):
            place = np.where(np.isin(k, heavy), _mix(i.view(np.uint64)), place)
        bucket = (place >> shift).astype(np.uint16 if bits <= 16 else np.int32) if bits else np.zeros(len(k), np.uint16)
        order = np.argsort(bucket, kind="stable")  # by digits for 16 bits
        k, i, bucket = k[order], i[order], bucket[order].astype(np.int32)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(starts[1:], len(k))
        packed = [k[a:b].tobytes() + i[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(packed, pa.binary())], schema=schema)

    def run(batches):
        parts, held = [], 0
        for batch in keys(batches):
            parts.append((batch.column("key").to_numpy(), batch.column("id").to_numpy()))
            held += batch.num_rows
            if held >= PACKED:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _split(heavy: np.ndarray):
    """Rows (bucket, packed) sorted by bucket to pairs of small groups and members of large ones.

    A bucket holds all pairs of its keys, but for heavy keys, whose groups come in parts.  Of a bucket beyond HELD
    pairs every group of two and more is taken for a large one in parts, so nothing is held longer.
    """
    out = _Groups()

    def emit(parts, parted):
        k, i = (np.concatenate(x) for x in zip(*parts))
        known = np.isin(k, heavy) if len(heavy) else np.zeros(len(k), bool)
        if known.any():
            yield out.large(k[known], i[known], parted=True)
            k, i = k[~known], i[~known]
        order = np.argsort(k)
        k, i = k[order], i[order]
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else _NONE
        size = np.diff(np.append(starts, len(k)))
        if parted:
            every = np.repeat(size > 0, size)
            if every.any():
                yield out.large(k, i, parted=True)
            return
        few, large = np.repeat((size > 1) & (size <= SMALL), size), np.repeat(size > SMALL, size)
        if few.any():
            yield out.pairs(k[few], i[few])
        if large.any():
            yield out.large(k[large], i[large])

    def run(batches):
        parts, held, now, parted = [], 0, None, False
        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                if bucket != now:
                    if parts:
                        yield from emit(parts, parted)
                    parts, held, now, parted = [], 0, bucket, False
                both = np.frombuffer(packed, np.int64).reshape(2, -1)
                parts.append((both[0], both[1]))
                held += both.shape[1]
                if held > HELD:
                    parted = True
                    yield from emit(parts, parted)
                    parts, held = [], 0
        if parts:
            yield from emit(parts, parted)

    return run


KEYED = "key long, id long"


def heavy_keys(source: DataFrame, keys) -> list[int]:
    """Keys of groups that are large for certain, ONE_IN at most."""
    counts = saved(source.sample(SAMPLED, seed=17).mapInArrow(keys, KEYED).groupBy("key").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(r.key for r in counts.where(F.col("n") >= max(HEAVY, total // ONE_IN)).collect())


def grouped(source: DataFrame, keys, expected: int, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b), repeated ones left in, and (family, id): the members of large groups are all in one family.

    keys turns Arrow batches of source into batches (key, id), `expected` of them in all, about; keys are spread
    evenly over 64 bits.  Pairs are those of small groups, and of each id in large ones with at most `most` leaders.
    """
    spark = source.sparkSession
    heavy = np.array(heavy_keys(source, keys), np.int64)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(MOST_BITS, max(expected // BUCKET, partitions).bit_length())
    rows = source.mapInArrow(_dealt(keys, bits, heavy), "bucket int, packed binary").repartition("bucket").sortWithinPartitions("bucket")
    rows = saved(rows.mapInArrow(_split(heavy), "family long, a long, b long"))
    release(spark)
    members = rows.where("family IS NOT NULL").groupBy("family", F.col("a").alias("id")).agg(F.count("*").alias("n"))
    members = saved(members)
    # an id's score is the number of large groups that it is in: the text that copies were made from is in most
    large = saved(members.join(members.groupBy("id").agg(F.sum("n").alias("score")), "id").select("family", "id", "score"))
    return rows.where("family IS NULL").select("a", "b").union(led(large, most)), large.select("family", "id")


def _foremost(rank, by, classes: int):
    """The greatest rank of each of some classes of ids, as one array."""
    part = F.pmod(F.xxhash64(by, F.lit(classes)), F.lit(classes))
    return F.array_compact(F.array(*[F.max(F.when(part == i, rank)) for i in range(classes)]))


def led(large: DataFrame, most: int) -> DataFrame:
    """Pairs of each id with at most so many of the LEADERS that its families have, by score."""
    leaders = large.groupBy("family").agg(_foremost(F.struct("score", "id"), F.col("id"), LEADERS).alias("l"))
    leaders = leaders.select("family", F.explode("l").alias("l")).select("family", F.col("l.id").alias("leader"), F.col("l.score").alias("score"))
    met = large.select("family", "id").join(leaders, "family").where("id <> leader")
    best = met.groupBy("id").agg(_foremost(F.struct("score", "leader"), F.col("leader"), most).alias("l"))
    both = best.select("id", F.explode("l.leader").alias("leader"))
    return both.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in an edge (a, b); component is the smallest id.

    Alternating large-star and small-star steps; every round is written to the shared folder.
    """
    def mark(df):
        return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()

    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = mark(now)
    while seen["n"]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(1) if seen["n"] <= ONE_TASK else both  # few edges need no exchange at all
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = saved(small.select("e.*").where("u <> v").distinct(), instead=now)
        was, seen = seen, mark(now)
        if was == seen:
            break
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def _counted(batches):
    """(chunk, counts): how many shingles of the sets are in each bucket, a chunk of buckets in a row."""
    total = np.zeros(BUCKETS, np.uint32)
    for batch in pieces(batches, 512):
        flat = batch.column("hashes").flatten().to_numpy().view(np.uint64)
        np.add.at(total, (flat % np.uint64(BUCKETS)).astype(np.int64), np.uint32(1))  # of the table's type, or else it is slow
    pack = zstandard.ZstdCompressor(level=1).compress  # most counts are 0 or small
    rows = [(i, pack(part.tobytes())) for i, part in enumerate(np.split(total, CHUNKS)) if part.any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=["chunk", "counts"])


def _summed(batches):
    """One row for each chunk from rows sorted by chunk."""
    now, total = None, None
    unpack = zstandard.ZstdDecompressor().decompress
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(unpack(counts), np.uint32)
            if chunk != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=schema)
                now, total = chunk, part.copy()
            else:
                total = np.maximum(total, total + part)  # stays where it would overflow
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=schema)


_ROWS = "key long, id long, component long, n long, pos long, side long, whole boolean, prev long"


def _prefixes(counts: np.ndarray):
    """The prefix of each set as keys, with the set's size and the shingle's position; long lists as pairs of blocks."""
    def run(batches):
        for batch in pieces(batches, 512):
            ids, comps = batch.column("id").to_numpy(), batch.column("component").to_numpy()
            lists = batch.column("hashes")
            flat, offsets = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            blocks = _mix(ids.view(np.uint64))
            all_often = counts[(flat % np.uint64(BUCKETS)).astype(np.int64)].astype(np.int64)
            sizes = np.diff(offsets).astype(np.int64)
            length = np.where(sizes > 0, sizes - (PERCENT * sizes + 99) // 100 + 1, 0)
            first = [np.lexsort((flat[a:b], all_often[a:b]))[:m] + a for a, b, m in zip(offsets[:-1].tolist(), offsets[1:].tolist(), length.tolist())]
            first = np.concatenate([_NONE, *first])
            of = np.repeat(np.arange(len(ids)), length)
            pos = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
            met = all_often[first] > 1  # a shingle of one set alone meets nothing
            x, often, of, pos = flat[first][met], all_often[first][met], of[met], pos[met]
            before = np.zeros(len(x), np.uint64)  # the shingle before in the set's prefix; 0: none
            before[1:] = np.where(of[1:] == of[:-1], x[:-1], np.uint64(0))
            all_parts = (often - 1) // BLOCK + 1
            made = np.cumsum(all_parts) // 100_000
            for rows in np.split(np.arange(len(x)), np.flatnonzero(made[1:] != made[:-1]) + 1):
                if not len(rows):
                    continue
                parts = all_parts[rows]
                row = np.repeat(rows, parts)
                other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                i = of[row]
                own = (blocks[i] % all_parts[row].astype(np.uint64)).astype(np.int64)
                low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
                key = _mix(_mix(x[row] * _GOLD + low) * _GOLD + high)
                columns = key.view(np.int64), ids[i], comps[i], sizes[i], pos[row], own, own == other, before[row].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES)

    return run


_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _met(batches):
    """Pairs of sorted rows with one key whose sizes and positions let them reach PERCENT, from different components.

    A pair whose last shingles before this one are the same has met there, with more of both sets after it.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def few(key, comp, low, high, apart, prev):
        """Rows of pairs in short lists, one distance after another."""
        at = np.arange(len(key))
        for d in range(1, SMALL):
            at = at[: np.searchsorted(at, len(key) - d)]  # keys are sorted: who meets no key at one distance meets none further on
            at = at[key[at + d] == key[at]]
            if not len(at):
                break
            to = at + d
            good = (comp[at] != comp[to]) & (low[at] <= high[to]) & (low[to] <= high[at]) & ((apart[at] < 0) | (apart[at] != apart[to])) & ((prev[at] != prev[to]) | (prev[at] == 0))
            yield at[good], to[good]

    def many(comp, low, high, apart, prev):
        """The same for one list, rows against all that follow them."""
        n, first = len(comp), 0
        while first < n - 1:
            end = min(n, first + max(1, CELLS // (n - first)))
            x, y = slice(first, end), slice(first, n)
            good = comp[x, None] != comp[None, y]
            good &= low[x, None] <= high[None, y]
            good &= high[x, None] >= low[None, y]
            if apart[first] >= 0:
                good &= apart[x, None] != apart[None, y]
            good &= (prev[x, None] != prev[None, y]) | (prev[x, None] == 0)
            i, j = np.nonzero(good)
            i, j = i[j > i], j[j > i]
            yield first + i, first + j
            first = end

    def found(c):
        key, ids, comp, n, pos, side, whole, prev = c
        low, high = PERCENT * n, (100 + PERCENT) * (n - pos) - PERCENT * n  # min(rest) against both sizes, one side at a time
        apart = np.where(whole, -1, side)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(starts, len(key)))
        short = np.flatnonzero(np.repeat(size <= SMALL, size))
        for i, j in few(*(x[short] for x in (key, comp, low, high, apart, prev))):
            yield ids[short[i]], ids[short[j]]
        for k in np.flatnonzero(size > SMALL).tolist():
            of = slice(starts[k], starts[k] + size[k])
            for i, j in many(*(x[of] for x in (comp, low, high, apart, prev))):
                yield ids[of][i], ids[of][j]

    def emit(c):
        left, right, held = [], [], 0
        for a, b in found(c):
            left.append(np.minimum(a, b))
            right.append(np.maximum(a, b))
            held += len(a)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=schema)
                left, right, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=schema)

    kept = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in _NAMES]
        kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
        if not len(kept[0]):
            continue
        last = int(np.searchsorted(kept[0], kept[0][-1]))
        yield from emit([c[:last] for c in kept])
        kept = [c[last:] for c in kept]
    if kept is not None:
        yield from emit(kept)


def candidates(sets: DataFrame) -> DataFrame:
    """Every pair (a < b) of sets (id, component, hashes) that can reach PERCENT, where the components differ.

    With one order for all sets, two sets at PERCENT share a shingle among the first
    n - ceil(0.8 n) + 1 of both, and the first they share leaves enough after it.
    """
    counts = np.zeros((CHUNKS, BUCKETS // CHUNKS), np.uint32)
    each = sets.select("hashes").mapInArrow(_counted, "chunk int, counts binary")
    summed = each.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, "chunk int, counts binary")
    for r in summed.toLocalIterator():  # CHUNKS rows, BUCKETS numbers in all
        counts[r.chunk] = np.frombuffer(r.counts, np.uint32)
    counts = counts.ravel()
    rows = sets.mapInArrow(_prefixes(counts), _ROWS)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_met, "a long, b long").distinct()


def verified(pairs: DataFrame, verify: Callable[[DataFrame], DataFrame], at_once: int) -> DataFrame:
    """The true links of written pairs (a, b).

    Pairs of sets that differ can be many times the sets, and each brings two of them along; so about `at_once` are
    looked at in a round, and a round's exchanges go before the next.
    """
    spark = pairs.sparkSession
    rounds = max(1, -(-pairs.count() // at_once))
    part = F.pmod(F.xxhash64(F.lit(rounds), "a", "b"), F.lit(rounds))
    links = []
    for k in range(rounds):
        links.append(saved(verify(pairs.where(part == k) if rounds > 1 else pairs)))
        release(spark)
    return reduce(DataFrame.union, links)


def link(
    source: DataFrame,
    keys: Callable,
    expected: int,
    prepare: Callable[[DataFrame], None],
    verify: Callable[[DataFrame], DataFrame],
    sets: Callable[[DataFrame], DataFrame],
    most: int = 3,
) -> DataFrame:
    """(id, component) of every id that has a verified link.

    keys turns Arrow batches of source into batches (key, id), about `expected` rows; prepare(ids) is told once which ids may have to be verified; verify
    keeps the true links of pairs (a, b); sets(ids) gives (id, hashes), the sorted full sets of such ids; `most`:
    leaders that an id is paired with before the exact join.
    """
    spark, at_once = source.sparkSession, max(PAIRS, expected // PAIRS_OF_KEYS)
    pairs, large = grouped(source, keys, expected, most)
    pairs = saved(pairs.distinct())
    release(spark)
    prepare(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())  # everyone in a large group has a partner
    release(spark)
    edges = verified(pairs, verify, at_once)
    found = saved(components(edges))
    release(spark)
    named = large.join(found, "id", "left").select("family", "id", F.coalesce("component", "id").alias("component"))
    apart = named.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("family")
    still = saved(named.join(apart, "family", "left_semi").select("id", "component").distinct())
    if still.isEmpty():
        return found
    full = saved(sets(still.select("id")).join(still, "id").select("id", "component", "hashes"))
    release(spark)
    met = saved(candidates(full), instead=full)
    release(spark)
    more = verified(met, verify, at_once)
    if more.isEmpty():
        return found
    return saved(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)))
