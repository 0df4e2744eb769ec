"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A batch of texts becomes one array of code points, one lookup turns it into
symbols (letter, number, other, white space by what follows, apostrophe that
may open a contraction), and a transition-function scan finds the boundaries:
every symbol is a function on the automaton's states, functions are numbered
elements of its transition monoid, and composition, being associative, is one
table lookup, so the scan runs over many blocks at once.  No regular
expression is used.  The slices go through a cache of merged pieces; each piece's
code-point offset is kept, so tokens map back to the text, and decoding joins
the tokens' bytes.

Pieces are those of the pattern
  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Defined cases: null text is empty and has no tokens; repeated rows are encoded
alike; an empty table gives no rows; other columns are ignored by `encode`;
a lone surrogate raises UnicodeEncodeError, as it has no bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netmine.llm.common import pieces

# Symbols.  WS: white space followed by white space or the end; SP: a space, and
# ODD: other white space, followed by something else; Q1, Q2: an apostrophe
# followed by a contraction's one or two letters; END: between texts.
LET, NUM, OTH, WS, SP, ODD, Q1, Q2, END = range(9)
# States: what the last code point belongs to.  GLUE: a space that joins the next
# piece; C2, C1: a contraction with two or one letters to come; FREE: the next
# code point opens a piece.
S_FREE, S_LET, S_NUM, S_OTH, S_GLUE, S_WS, S_C2, S_C1 = range(8)
N_STATES = 8
NEVER = np.iinfo(np.int32).max


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this symbol."""
    if symbol == END:
        return S_FREE, True
    if symbol == LET:
        if state == S_C2:
            return S_C1, False
        if state == S_C1:
            return S_FREE, False
        return S_LET, state not in (S_LET, S_GLUE)
    if symbol == NUM:
        return S_NUM, state not in (S_NUM, S_GLUE)
    if symbol == OTH or (symbol in (Q1, Q2) and state in (S_OTH, S_GLUE)):
        return S_OTH, state not in (S_OTH, S_GLUE)
    if symbol == WS:
        return S_WS, state != S_WS
    return {SP: S_GLUE, ODD: S_FREE, Q1: S_C1, Q2: S_C2}[symbol], True


@functools.cache
def automaton():
    """Flat tables: element of each symbol, composition, state after (element, state), start by (state, symbol)."""
    gens = [tuple(_step(s, y)[0] for s in range(N_STATES)) for y in range(9)]
    elements = [tuple(range(N_STATES))]
    index = {elements[0]: 0}
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
                todo.append(h)
    n = len(elements)
    assert n <= 16  # two elements, and an element and a state, fit one byte
    compose = np.zeros((16, 16), dtype=np.uint8)
    compose[:n, :n] = [[index[tuple(g[x] for x in f)] for g in elements] for f in elements]
    after = np.zeros((16, N_STATES), dtype=np.uint8)
    after[:n] = elements
    starts = np.zeros((N_STATES, 16), dtype=bool)
    starts[:, :9] = [[_step(s, y)[1] for y in range(9)] for s in range(N_STATES)]
    return np.array([index[g] for g in gens], dtype=np.uint8), compose.ravel(), after.ravel(), starts.ravel()


@functools.cache
def class_table() -> np.ndarray:
    out = np.full(0x110000, OTH, dtype=np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    out[kinds == "L"] = LET
    out[kinds == "N"] = NUM
    # The code points with the White_Space property.
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WS
    return out


def scan(elements: np.ndarray) -> np.ndarray:
    """State before each position, by blocks: compose within blocks, then across, then apply."""
    _, compose, after, _ = automaton()
    size = len(elements)
    width = max(1, int(np.sqrt(size) / 4))
    rows = -(-size // width)
    padded = np.zeros(rows * width, dtype=np.uint8)  # 0 is the identity
    padded[:size] = elements
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    acc = np.zeros(rows, dtype=np.uint8)
    before = np.empty((width, rows), dtype=np.uint8)
    for j in range(width):
        before[j] = acc
        acc = compose[(acc << 4) | columns[j]]
    carry, state = np.empty(rows, dtype=np.uint8), S_FREE
    for i, e in enumerate(acc.tolist()):
        carry[i] = state
        state = int(after[e * N_STATES + state])
    before <<= 3
    before |= carry[None, :]
    return np.ascontiguousarray(after[before].T).reshape(-1)[:size]


def piece_starts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Start of every piece and of every text (with one END between) in the joined code points; those; their string."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + 1) - 1
    kind = class_table()[points]
    is_end = np.zeros(len(points), dtype=bool)
    is_end[ends] = True
    kind[is_end] = END
    after = np.append(kind[1:], END)
    space = (kind == WS) & (after != WS) & (after != END)
    kind[space] = np.where(points[space] == 0x20, SP, ODD)
    quotes = np.flatnonzero((points == 0x27) & ~is_end)
    if len(quotes):
        # The contractions' letters.
        tail = np.append(points, [0, 0, 0])
        a, b = tail[quotes + 1], tail[quotes + 2]
        is_a = ~np.append(is_end, [True] * 3)[quotes + 1]
        is_b = is_a & ~np.append(is_end, [True] * 3)[quotes + 2]
        one = is_a & np.isin(a, [ord(c) for c in "stmd"])
        two = is_b & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        kind[quotes[one]] = Q1
        kind[quotes[two]] = Q2
    gens, _, _, flags = automaton()
    states = scan(gens[kind])
    opens = flags[(states << 4) | kind]
    opens[ends] = False
    return np.flatnonzero(opens), np.append(0, ends + 1), points, joined


#: Fixed odd multipliers of the piece hash.
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_P_INVERSE = pow(_P, -1, 1 << 64)


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, p, dtype=np.uint64))) for p in (_P, _P_INVERSE))


def piece_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of every slice from one running sum; the length goes in too."""
    up, down = _powers(max(1, int(len(points)).bit_length()))
    x = points.astype(np.uint64) + np.uint64(1)
    x *= np.uint64(_Q)
    x ^= x >> np.uint64(29)
    total = np.append(np.uint64(0), np.cumsum(x * up[: len(x)]))
    out = (total[ends] - total[starts]) * down[starts]
    return out ^ ((ends - starts).astype(np.uint64) * np.uint64(_Q))


class Encoder:
    """Ranks with a bounded cache of merged pieces."""

    CACHE = 1 << 20

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.bytes_of}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self._pairs = None
        self._forget()

    @classmethod
    def from_bytes(cls, data: bytes) -> Encoder:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) })

    def pair_table(self):
        """Open-addressed table from (left id, right id) to the merged id, of every split of every token."""
        if self._pairs is None:
            ranks = self.ranks
            found = {
                (ranks[t[:i]] << 20) | ranks[t[i:]]: r
                for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
            }
            keys, values = (np.fromiter(x, dtype=np.int64, count=len(found)) for x in (found.keys(), found.values()))
            bits = max(8, int(len(found) * 4).bit_length())
            table = np.full(1 << bits, -1, dtype=np.int64)
            value = np.zeros(1 << bits, dtype=np.int64)
            slot = self._slot(keys, bits)
            left = np.arange(len(keys))
            while len(left):
                free = left[table[slot[left]] < 0]
                table[slot[free]] = keys[free]  # of several for one slot the last stays
                placed = table[slot[left]] == keys[left]
                value[slot[left[placed]]] = values[left[placed]]
                left = left[~placed]
                slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
            self._pairs = bits, table, value
        return self._pairs

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def merged_id(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NEVER if there is none."""
        bits, table, value = self.pair_table()
        keys = (left.astype(np.int64) << 20) | right
        out = np.full(keys.shape, NEVER, dtype=np.int32)
        flat, keys = out.reshape(-1), keys.reshape(-1)
        todo, slot = np.arange(len(keys)), self._slot(keys, bits)
        while len(todo):
            seen = table[slot]
            hit = seen == keys[todo]
            flat[todo[hit]] = value[slot[hit]]
            more = (seen >= 0) & ~hit
            todo, slot = todo[more], (slot[more] + 1) & ((1 << bits) - 1)
        return out

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, joined, and how many each has.

        Pieces of one length are merged together: lowest rank first, leftmost of equal ranks.
        """
        sizes = np.ones(len(pieces), dtype=np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = []
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        for n, where in by_length.items():
            rows = np.array(where)
            if n > 64:
                made += [(np.array([i]), np.array([self.merge_long(pieces[i])], dtype=np.int32)) for i in where]
                continue
            whole = np.array([self.ranks.get(pieces[i], -1) for i in where], dtype=np.int32)
            made.append((rows[whole >= 0], whole[whole >= 0, None]))
            rows = rows[whole < 0]
            if not len(rows):
                continue
            raw = np.frombuffer(b"".join([pieces[i] for i in rows.tolist()]), dtype=np.uint8).reshape(len(rows), n)
            ids = self.byte_ids[raw]
            pairs = self.merged_id(ids[:, :-1], ids[:, 1:])
            while len(rows):
                at = pairs.argmin(axis=1)
                line = np.arange(len(rows))
                best = pairs[line, at]
                if (done := best == NEVER).any():
                    made.append((rows[done], ids[done]))
                    keep = ~done
                    ids, pairs, rows, at, best = ids[keep], pairs[keep], rows[keep], at[keep], best[keep]
                    if not len(rows):
                        break
                    line = np.arange(len(rows))
                width = ids.shape[1] - 1
                column = np.arange(width)[None, :]
                ids = np.where(column > at[:, None], ids[:, 1:], ids[:, :-1])
                ids[line, at] = best
                if width == 1:
                    made.append((rows, ids))
                    break
                column = column[:, : width - 1]
                pairs = np.where(column >= at[:, None], pairs[:, 1:], pairs[:, :-1])
                l = np.flatnonzero(at > 0)
                pairs[l, at[l] - 1] = self.merged_id(ids[l, at[l] - 1], ids[l, at[l]])
                r = np.flatnonzero(at < width - 1)
                pairs[r, at[r]] = self.merged_id(ids[r, at[r]], ids[r, at[r] + 1])
        for rows, ids in made:
            sizes[rows] = ids.shape[1]
        first = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), dtype=np.int32)
        for rows, ids in made:
            flat[first[rows][:, None] + np.arange(ids.shape[1])[None, :]] = ids
        return flat, sizes

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges of one long piece in n log n steps: a heap over a linked list."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once merged away
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or (mid := end[i]) >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _number(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: str) -> np.ndarray:
        """Cache number of every piece; pieces not yet there are merged.  Equal hashes are confirmed on the pieces."""
        values, first, inverse = np.unique(piece_hashes(points, starts, ends), return_index=True, return_inverse=True)
        if len(self.texts) + len(values) > self.CACHE or len(self.cache) < len(self.texts):
            self._forget()
        texts = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        get = self.cache.get
        numbers = np.array([get(h, -1) for h in values.tolist()], dtype=np.int64)
        new, old = np.flatnonzero(numbers < 0), np.flatnonzero(numbers >= 0)
        same = [texts[i] for i in old.tolist()] == [self.texts[i] for i in numbers[old].tolist()]
        size = ends - starts
        if not same or not np.array_equal(size[first][inverse], size):
            return self._number_slowly(starts, ends, joined)
        upto = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        if not np.array_equal(points[np.repeat(starts[first][inverse] - upto, size) + step], points[np.repeat(starts - upto, size) + step]):
            return self._number_slowly(starts, ends, joined)
        if len(new):
            fresh = [texts[i] for i in new.tolist()]
            flat, sizes = self.merge_many([t.encode("utf-8") for t in fresh])
            numbers[new] = np.arange(len(self.texts), len(self.texts) + len(new))
            self.cache.update(zip(values[new].tolist(), numbers[new].tolist()))
            self.texts += fresh
            self.offsets = np.append(self.offsets, self.offsets[-1] + np.cumsum(sizes))
            self.flat.append(flat)
        return numbers[inverse]

    def _forget(self) -> None:
        self.cache: dict[int, int] = {}
        self.texts: list[str] = []
        self.offsets = np.zeros(1, dtype=np.int64)
        self.flat: list[np.ndarray] = []

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: ids, start of each piece (code points), number of ids of each piece."""
        starts, firsts, points, joined = piece_starts(texts)
        cuts = np.searchsorted(starts, firsts)
        owner = np.searchsorted(firsts, starts, "right")
        ends = np.minimum(np.append(starts[1:], len(points)), firsts[owner] - 1)  # a text's last piece ends before END
        numbers = self._number(points, starts, ends, joined)
        flat = np.concatenate(self.flat) if self.flat else np.zeros(0, dtype=np.int32)
        self.flat = [flat]
        sizes = np.diff(self.offsets)[numbers] if len(numbers) else np.zeros(0, dtype=np.int64)
        upto = np.append(0, np.cumsum(sizes))
        ids = flat[np.repeat(self.offsets[numbers] - upto[:-1], sizes) + np.arange(upto[-1])]
        at = upto[cuts]
        return [
            (ids[at[k] : at[k + 1]], starts[cuts[k] : cuts[k + 1]] - firsts[k], sizes[cuts[k] : cuts[k + 1]])
            for k in range(len(texts))
        ]

    def _number_slowly(self, starts: np.ndarray, ends: np.ndarray, joined: str) -> np.ndarray:
        """For a batch where two pieces share a hash: numbers by the pieces themselves; nothing stays cached."""
        self._forget()
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        number = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        self.texts = list(number)
        flat, sizes = self.merge_many([t.encode("utf-8") for t in self.texts])
        self.flat, self.offsets = [flat], np.append(0, np.cumsum(sizes))
        return np.array([number[p] for p in pieces], dtype=np.int64)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> bytes:
    """The vocabulary file's bytes (about 1 MB), to be broadcast."""
    with open(path, "rb") as f:
        return f.read()


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """One of the installed public vocabularies."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name))


def batches_of(texts: list[str], most: int = 1 << 19):
    """Runs of texts with about `most` code points each; a longer text stands alone."""
    group, held = [], 0
    for t in texts:
        if group and held + len(t) > most:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def mapped(spark: SparkSession, df: DataFrame, ranks: bytes, columns: list[str], row, schema: pa.Schema, ddl: str) -> DataFrame:
    """`columns` of every row beside what `row(encoder, text, ids, starts, counts)` gives for its text, of the types of `schema`."""
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches):
        encoder = Encoder.from_bytes(shared.value)
        for batch in pieces(batches, 1024):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [row(encoder, t, *e) for g in batches_of(texts) for t, e in zip(g, encoder.encode_batch(g))]
            made = list(zip(*found))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in columns] + [pa.array(c, type=f.type) for c, f in zip(made, schema)], names=[*columns, *schema.names]
                )

    return df.mapInArrow(run, ddl)


def encode(spark: SparkSession, docs: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, ids, piece_starts (code points), piece_sizes (ids in each piece)."""
    schema = pa.schema([(n, pa.list_(pa.int32())) for n in ("ids", "piece_starts", "piece_sizes")])
    return mapped(
        spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ranks, ["doc_id"],
        lambda encoder, text, ids, starts, counts: (ids, starts, counts), schema,
        "doc_id long, ids array<int>, piece_starts array<int>, piece_sizes array<int>",
    )


def decode(spark: SparkSession, encoded: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id and the decoded bytes of the column `ids`."""
    shared = spark.sparkContext.broadcast(ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches):
        encoder = Encoder.from_bytes(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([encoder.decode(x) for x in batch.column("ids").to_pylist()], pa.binary())], schema=schema
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(spark: SparkSession, docs: DataFrame, ranks: bytes, columns: list[str] | None = None) -> DataFrame:
    """`columns` (doc_id by default), n_tokens, ids_sha256, decoded_sha256; ids are decoded again, text by text."""
    columns = columns or ["doc_id"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"

    def row(encoder, text, ids, starts, counts):
        ids = ids.tolist()
        return (
            len(ids),
            hashlib.sha256(" ".join(map(encoder.names.__getitem__, ids)).encode()).hexdigest(),
            hashlib.sha256(encoder.decode(ids)).hexdigest(),
        )

    return mapped(spark, docs.select(*dict.fromkeys([*columns, "text"])), ranks, columns, row, schema, ddl)
