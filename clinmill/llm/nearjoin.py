"""Candidate pairs of near-equal texts by a vertically partitioned set join.

All words have one global order, the rarest first.  A pair that reaches the
Jaccard threshold shares a word among the first words of both (the prefixes), and
no more words than the threshold allows stand before the first one it shares.

The order is cut into *fragments*: ranges with about equally many prefix words.
Each text sends each fragment the segment of its prefix that falls into it.
Inside a fragment, texts that share a word are compared by the bounds of length,
position and parity bitmap; for the pairs that are left the words that both
segments have and those that only one has are counted.  These partial counts are
summed per pair over the fragments, and a pair whose sums already hold more
differences than the threshold allows is dropped.  Every step is a bound that
holds for all pairs at the threshold, so none is lost.

A word whose segments are more than a fragment may hold is split: its texts fall
into parts by hash, and each two parts meet in a group of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets of up to this many keys are broadcast; beyond it a shuffle join is used.
BROADCAST_KEYS = 1_000_000
#: Words are ordered by the frequency of one of so many hash buckets (a table of fixed size).
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Bits of an ordered word below its bucket's rank; words are hashes of 48 bits.
BELOW = 48 - BUCKET_BITS
#: Prefix words that one group of a fragment holds, and pairs of texts with a word in common.
SEGMENTS, MEETINGS = 1 << 18, 1 << 30
#: Lists of up to this many texts are paired by index, longer ones in tiles of STRIP by WIDE texts, which stay in the caches.
SHORT_LIST, STRIP, WIDE = 32, 64, 2048
#: Least width of a bitmap in bits.
NARROWEST = 128
ONE, TWO = 1, 2
ORDERED = "h bigint, nw int, side int, bits binary, prefix binary"
SEGMENT = "grp bigint, h bigint, nw int, side int, part int, start int, ends boolean, bits binary, words binary"
PARTIAL = "h1 bigint, h2 bigint, n1 int, n2 int, common int, only1 int, only2 int"


def rows_of(schema: str, *columns: np.ndarray | list | pa.Array) -> pa.RecordBatch:
    """A record batch with the names of a schema string."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in schema.split(", ")])


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of a flat array as binary values."""
    ends = np.r_[0, np.cumsum(lengths)] * values.itemsize
    if ends[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    flat = values.tobytes()
    return pa.array([flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())


def flat(column: pa.Array | pa.ChunkedArray, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column end to end, and how many each row has."""
    values, lengths = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(part):
            _, offsets, data = part.buffers()
            ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(part.type) else np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
            lengths.append(np.diff(ends) // np.dtype(kind).itemsize)
            if ends[-1] > ends[0]:
                values.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind))
    return (values[1] if len(values) == 2 else np.concatenate(values)), np.concatenate(lengths)


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def widths(nw: np.ndarray) -> np.ndarray:
    """Bits of the bitmaps of texts with ``nw`` words: a power of two, at least 1.5 a word."""
    return np.maximum(NARROWEST, 1 << np.ceil(np.log2(1.5 * np.maximum(nw, 1))).astype(np.int64))


def bitmaps(doc: np.ndarray, values: np.ndarray, nw: np.ndarray) -> list[bytes]:
    """For each text a bitmap, each bit the parity of how many of its values fall on it."""
    out: list[bytes] = [b""] * len(nw)
    width = widths(nw)
    for bits in np.unique(width).tolist():
        members = np.flatnonzero(width == bits)
        for at in range(0, len(members), max(1, (1 << 22) // bits)):
            some = members[at : at + max(1, (1 << 22) // bits)]
            place = np.full(len(nw), -1, np.int64)
            place[some] = np.arange(len(some))
            own = place[doc] >= 0
            cell = place[doc[own]] * bits + (values[own] % np.uint64(bits)).astype(np.int64)
            odd = (np.bincount(cell, minlength=bits * len(some)) & 1).astype(np.uint8)
            for i, packed in zip(some.tolist(), np.packbits(odd.reshape(len(some), bits), axis=1)):
                out[i] = packed.tobytes()
    return out


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of (n, k) 64-bit words as bitmaps of fewer words; bits that meet are added modulo 2."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def telling(have: int, n: int, most: int) -> tuple[int, int]:
    """To how many 64-bit words bitmaps are folded, and how many of these are
    looked at first: the fewest that tell all but a hundredth of the pairs of unlike
    texts with ``n`` words together from those that differ in at most ``most`` bits.
    Four at most: 256 differences count as none in a byte, so the pair is looked at again."""
    for fold, used in ((2, 2), (4, 3)):
        if used < have and 32 * used * (1 - math.exp(-1.4 * n / (64 * fold))) - 9 * math.sqrt(used) >= most:
            return fold, used
    return min(have, 4), min(have, 4)


def least_common(n1: np.ndarray, n2: np.ndarray, tenths: int) -> np.ndarray:
    """Words that texts of ``n1`` and ``n2`` words have in common at the threshold, at least."""
    return -((-(n1 + n2) * tenths) // (10 + tenths))


def prefix_lengths(nw: np.ndarray, tenths: int) -> np.ndarray:
    """Words at the front of the order of which a pair at the threshold shares one."""
    return nw + (-nw * tenths) // 10 + 1


def keys_of(values: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """48-bit words as numbers that rise along the global order; no two words become one."""
    return (rank[(values & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(BELOW)) | (values >> np.uint64(BUCKET_BITS))


def bucket_counts(rows: DataFrame, column: str, bucket: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How often each bucket occurs; each task sends at most ``BUCKETS`` counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(bucket(flat(b.column(0))[0]), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield rows_of("bucket int, n bigint", some.astype(np.int32), total[some])

    out = np.zeros(BUCKETS, np.int64)
    counted = rows.select(column).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    out[counted["bucket"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out


def cut_order(postings: np.ndarray, most: int = SEGMENTS, meetings: int = MEETINGS) -> tuple[np.ndarray, np.ndarray]:
    """Fragment of each rank, and the parts that each fragment's texts fall into.

    A fragment has at most ``most`` postings and ``meetings`` (the sum of the
    squares of its buckets' postings); a bucket above either is a fragment of
    its own, in parts if it has more than ``most`` postings.
    """
    fragment = np.zeros(len(postings), np.int32)
    parts, held, met = [1], 0, 0
    for r, n in enumerate(postings.tolist()):
        if held and (held + n > most or met + n * n > meetings):
            parts.append(1)
            held = met = 0
        held += n
        met += n * n
        parts[-1] = max(1, -(-held // most))
        fragment[r] = len(parts) - 1
    return fragment, np.array(parts, np.int64)


class Group:
    """The segments of one group of a fragment."""

    def __init__(self, table: pa.Table, tenths: int) -> None:
        self.tenths = tenths
        self.h, self.n, self.side, self.part, start, self.ends = (table.column(c).to_numpy() for c in ("h", "nw", "side", "part", "start", "ends"))
        self.n = self.n.astype(np.int64)
        words, self.own = flat(table.column("words"))
        self.row = np.repeat(np.arange(len(self.h)), self.own)
        self.pos = np.repeat(start.astype(np.int64), self.own) + within(self.own)
        self.known, self.word = np.unique(words, return_inverse=True)
        self.first = np.cumsum(self.own) - self.own
        width = widths(self.n)
        maps, size = flat(table.column("bits"))
        begin = np.cumsum(size) - size
        self.width, self.maps, self.slot = width, {}, {}
        kinds = np.unique(width).tolist()
        for bits in kinds:
            self.slot[bits] = np.full(len(self.h), -1)
            held = [np.zeros((0, bits // 64), np.uint64)]
            at = 0
            for wide in (b for b in kinds if b >= bits):
                some = np.flatnonzero(width == wide)
                held.append(folded(maps[begin[some, None] + np.arange(wide // 64)], bits // 64))
                self.slot[bits][some] = np.arange(at, at + len(some))
                at += len(some)
            self.maps[bits] = np.concatenate(held)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of rows differ in no more bits than the threshold allows."""
        ok = np.zeros(len(x), bool)
        bits = np.minimum(self.width[x], self.width[y])
        most = self.n[x] + self.n[y] - 2 * least_common(self.n[x], self.n[y], self.tenths)
        for b in np.unique(bits).tolist():
            some = np.flatnonzero(bits == b)
            m, s = self.maps[b], self.slot[b]
            for at in range(0, len(some), (1 << 22) // b):
                k = some[at : at + (1 << 22) // b]
                ok[k] = np.bitwise_count(m[s[x[k]]] ^ m[s[y[k]]]).sum(axis=1, dtype=np.int64) <= most[k]
        return ok

    def allowed(self, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether words at places i and j can be the first that rows x and y share."""
        need = least_common(self.n[x], self.n[y], self.tenths)
        return (i <= self.n[x] - need) & (j <= self.n[y] - need)

    def tiled(self, rows: np.ndarray, cols: np.ndarray, triangle: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near pairs of two lists of postings of one word, tile by tile.

        A word at a place of a text can be the first that the text shares with
        another only if the other has no more than ``most`` words; so with both
        lists in the order of their lengths, a strip of the one meets a range of
        the other, and of that the texts whose ``most`` admits the strip.
        """
        t = self.tenths

        def by_length(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = at[np.argsort(self.n[self.row[at]], kind="stable")]
            r = self.row[at]
            return r, self.n[r], (10 + t) * (self.n[r] - self.pos[at]) // t - self.n[r]

        xs, nx, most_x = by_length(rows)
        ys, ny, most_y = (xs, nx, most_x) if triangle else by_length(cols)
        # of two texts of one list the shorter one is met in a strip
        left = np.flatnonzero(most_x >= nx) if triangle else np.arange(len(xs))
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def bitmaps_of(r: np.ndarray, bits: int, fold: int) -> np.ndarray:
            return np.ascontiguousarray(folded(self.maps[bits][self.slot[bits][r]], fold).T)

        words = np.empty(STRIP * WIDE, np.uint64)
        total, some = np.empty((2, STRIP * WIDE), np.uint8)
        found = []
        for at in range(0, len(left), STRIP):
            strip = left[at : at + STRIP]
            low = nx[strip[0]]
            begin = strip[0] if triangle else np.searchsorted(ny, -(-low * t // 10))
            range_y = begin + np.flatnonzero(most_y[begin : np.searchsorted(ny, most_x[strip].max(), "right")] >= low)
            for k in range(0, len(range_y), WIDE):
                q = range_y[k : k + WIDE]
                p = strip[most_x[strip] >= ny[q[0]]] if k else strip
                if not len(p):
                    break
                bits = int(min(self.width[xs[p[0]]], self.width[ys[q[0]]]))
                bound = (nx[p[-1]] + ny[q]) * (10 - t) // (10 + t)
                fold, used = telling(bits // 64, int(nx[p[-1]] + ny[q[-1]]), int(bound[-1]))
                if (bits, fold) not in kept:
                    u = bitmaps_of(xs, bits, fold)
                    kept[bits, fold] = u, u if triangle else bitmaps_of(ys, bits, fold)
                u, v = kept[bits, fold]
                shape, size = (len(p), len(q)), len(p) * len(q)
                w, differ, more = words[:size].reshape(shape), total[:size].reshape(shape), some[:size].reshape(shape)
                for i in range(used):
                    np.bitwise_xor(u[i][p][:, None], v[i][q], out=w)
                    np.bitwise_count(w, out=more if i else differ)
                    if i:
                        np.add(differ, more, out=differ)
                hit = (differ <= np.minimum(bound, 255).astype(np.uint8)).ravel().nonzero()[0]
                if len(hit):
                    i, j = np.divmod(hit, len(q))
                    found.append((p[i], q[j]))
        if found:
            i, j = (np.concatenate(z) for z in zip(*found))
            keep = (ny[j] <= most_x[i]) & (nx[i] <= most_y[j])
            if triangle:
                keep &= i < j
            x, y = xs[i[keep]], ys[j[keep]]
            keep = self.near(x, y)
            yield x[keep], y[keep]

    def pairs(self, rows: np.ndarray, cols: np.ndarray, triangle: bool) -> np.ndarray:
        """Distinct near pairs (x * number of rows + y), x of ``rows`` and y of
        ``cols`` (masks), each once and in the order of rows if ``triangle``."""
        n = len(self.h)
        found = [np.zeros(0, np.int64)]
        use = np.flatnonzero((rows | cols)[self.row])
        use = use[np.argsort(self.word[use], kind="stable")]
        count = np.bincount(self.word[use], minlength=len(self.known))
        begin = np.cumsum(count) - count
        for size in np.unique(count[(count > 1) & (count <= SHORT_LIST)]).tolist():
            a, b = np.triu_indices(size, 1)
            lists = begin[count == size]
            for at in range(0, len(lists), max(1, (1 << 20) // len(a))):
                some = lists[at : at + max(1, (1 << 20) // len(a)), None]
                p, q = use[(some + a).ravel()], use[(some + b).ravel()]
                x, y = self.row[p], self.row[q]
                ok = np.flatnonzero((rows[x] & cols[y]) | (rows[y] & cols[x]))
                ok = ok[self.allowed(x[ok], y[ok], self.pos[p[ok]], self.pos[q[ok]])]
                ok = ok[self.near(x[ok], y[ok])]
                x, y = x[ok], y[ok]
                if triangle:
                    found.append(np.minimum(x, y) * n + np.maximum(x, y))
                else:
                    found += [(x * n + y)[rows[x] & cols[y]], (y * n + x)[rows[y] & cols[x]]]
        for w in np.flatnonzero(count > SHORT_LIST).tolist():
            own = use[begin[w] : begin[w] + count[w]]
            for x, y in self.tiled(own[rows[self.row[own]]], own[cols[self.row[own]]], triangle):
                found.append(np.minimum(x, y) * n + np.maximum(x, y) if triangle else x * n + y)
        return np.unique(np.concatenate(found))

    def counted(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per pair: words of both segments, those of only x, those of only y, up
        to where the shorter of the two prefixes ends."""
        size = len(self.known) + 1
        codes = np.sort(self.row * size + self.word)
        last = np.full(len(self.h), size - 1)
        last[self.ends] = self.word[(self.first + self.own - 1)[self.ends]]
        limit = np.minimum(last[x], last[y])
        own1, own2 = (np.searchsorted(codes, z * size + limit, "right") - self.first[z] for z in (x, y))
        common = np.zeros(len(x), np.int64)
        step = 1 << 15
        for at in range(0, len(x), step):
            k = np.arange(at, min(at + step, len(x)))
            at_word = np.repeat(self.first[x[k]], self.own[x[k]]) + within(self.own[x[k]])
            of = np.repeat(k, self.own[x[k]])
            code = y[of] * size + self.word[at_word]
            found = np.searchsorted(codes, code)
            hit = codes[np.minimum(found, len(codes) - 1)] == code
            common += np.bincount(of[hit], minlength=len(x))
        return common, own1 - common, own2 - common

    def partial(self) -> pa.Table:
        """The near pairs of the group with their partial counts, as ``PARTIAL``."""
        alike = bool((self.side == 0).all())
        every = np.ones(len(self.h), bool)
        one, two = (every, every) if alike else (self.side & ONE != 0, self.side & TWO != 0)
        a, b = self.part.min(), self.part.max()
        if a == b:
            runs = [(one, two, alike)]
        else:
            runs = [(one & (self.part == a), two & (self.part == b), False)]
            runs += [] if alike else [(one & (self.part == b), two & (self.part == a), False)]
        code = np.unique(np.concatenate([self.pairs(*run) for run in runs]))
        x, y = code // len(self.h), code % len(self.h)
        x, y = x[self.h[x] != self.h[y]], y[self.h[x] != self.h[y]]
        common, only1, only2 = self.counted(x, y)
        if alike:
            turn = self.h[x] > self.h[y]
            x, y = np.where(turn, y, x), np.where(turn, x, y)
            only1, only2 = np.where(turn, only2, only1), np.where(turn, only1, only2)
        need = least_common(self.n[x], self.n[y], self.tenths)
        keep = (self.n[x] - only1 >= need) & (self.n[y] - only2 >= need)
        columns = (self.h[x], self.h[y], self.n[x].astype(np.int32), self.n[y].astype(np.int32), *(c.astype(np.int32) for c in (common, only1, only2)))
        return pa.Table.from_batches([rows_of(PARTIAL, *(c[keep] for c in columns))])


def candidates(texts: DataFrame, tenths: int, most: int = SEGMENTS) -> DataFrame:
    """Pairs (h1, h2) of texts that may reach a Jaccard of ``tenths`` / 10: all that do, few others.

    ``texts`` has rows of texts ``h`` (repeated ones count once) with ``nw``,
    ``bits``, ``values`` (the distinct words as 48-bit hashes) and ``side``: 0
    for all texts gives each pair once with h1 < h2; else h1 has ``ONE`` and h2
    has ``TWO`` among the bits of its sides.  ``most`` bounds the prefix words of
    a group.
    """
    low = np.uint64(BUCKETS - 1)
    seen = bucket_counts(texts, "values", lambda v: (v & low).astype(np.int64))
    rank = np.empty(BUCKETS, np.int32)
    rank[np.argsort(seen, kind="stable")] = np.arange(BUCKETS)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, count = flat(b.column(4))
            doc = np.repeat(np.arange(len(count)), count)
            key = keys_of(values, rank)
            key = key[np.lexsort((key, doc))]
            length = prefix_lengths(count, tenths)
            keep = within(count) < np.repeat(length, count)
            yield rows_of(ORDERED, *(b.column(k) for k in range(4)), binaries(key[keep], np.minimum(length, count)))

    rows = texts.select("h", "nw", "side", "bits", "values").mapInArrow(ordered, ORDERED)
    prefixes = rows.groupBy("h").agg(F.first("nw").alias("nw"), F.bit_or("side").alias("side"), *(F.first(c).alias(c) for c in ("bits", "prefix"))).persist(StorageLevel.MEMORY_AND_DISK)
    postings = bucket_counts(prefixes, "prefix", lambda v: (v >> np.uint64(BELOW)).astype(np.int64))
    fragment, parts = cut_order(postings, most)
    base = np.cumsum(parts * parts) - parts * parts

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, nw, side = (b.column(k).to_numpy() for k in range(3))
            words, count = flat(b.column(4))
            if not len(words):
                continue
            doc = np.repeat(np.arange(len(count)), count)
            piece = fragment[(words >> np.uint64(BELOW)).astype(np.int64)]
            begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])])
            length = np.diff(np.r_[begin, len(words)])
            of, f = doc[begin], piece[begin].astype(np.int64)
            ends = np.r_[of[1:] != of[:-1], True]
            k = parts[f]
            part = h[of] % k
            # a text meets each part of its fragment in one group
            many = np.repeat(np.arange(len(begin)), k)
            other = within(k)
            low_part, high_part = np.minimum(part[many], other), np.maximum(part[many], other)
            runs = np.repeat(begin[many], length[many]) + within(length[many])
            yield rows_of(
                SEGMENT, base[f[many]] + low_part * k[many] + high_part, h[of[many]], nw[of[many]], side[of[many]], part[many].astype(np.int32),
                (begin - (np.cumsum(count) - count)[of])[many].astype(np.int32), ends[many], b.column(3).take(pa.array(of[many])), binaries(words[runs], length[many]),
            )

    def group(table: pa.Table) -> pa.Table:
        return Group(table, tenths).partial()

    # as many tasks as groups, so that none gets several long ones
    groups = int((parts * (parts + 1) // 2).sum())
    partial = prefixes.mapInArrow(segments, SEGMENT).repartition(groups, "grp").groupBy("grp").applyInArrow(group, PARTIAL)
    summed = partial.groupBy("h1", "h2").agg(*(F.max(c).alias(c) for c in ("n1", "n2")), *(F.sum(c).alias(c) for c in ("common", "only1", "only2")))
    enough = lambda k: (F.col(f"n{k}") - F.col(f"only{k}")) * (10 + tenths) >= (F.col("n1") + F.col("n2")) * tenths
    return summed.where((F.col("common") > 0) & enough(1) & enough(2)).select("h1", "h2")


def only(rows: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """The rows with a key among ``n`` distinct keys: by broadcast if they are few."""
    return rows.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, key, "left_semi")
