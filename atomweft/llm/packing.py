"""Best-fit packing of token documents into sequences, refined by swap-based local search.

Each document (null text: empty) is its ids and the end id; only documents longer than a
sequence are cut, into full pieces and a last shorter one. Pieces are dealt by a hash into
groups of a bounded size; a group is packed best-fit-decreasing, and where it uses more bins
than a lower bound says, a local search moves, exchanges one for one, two for one or one for
two between underfull bins whenever that raises the sum of squared fills, until bins empty.
The search leaves off when the bound is met or no exchange between any two underfull bins is
left. What each group leaves in a bin that is at most half full is packed again, by the same
way in groups of its own, until one group is left: so only one sequence can be half empty.
Equal documents are packed alike and apart; an empty table gives no row; further columns are
not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordpiece

CAPACITY = 4096
GROUP_PIECES = 65_536
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices; lengths fall. An item goes where the least room stays free."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = defaultdict(list)  # free space -> bins
    free: list[int] = []  # the free spaces there are, ascending
    for i, size in enumerate(lengths):
        k = bisect.bisect_left(free, size)
        if k == len(free):
            bins.append([i])
            b, left = len(bins) - 1, capacity - size
        else:
            space = free[k]
            b = room[space].pop()
            if not room[space]:
                del free[k], room[space]
            bins[b].append(i)
            left = space - size
        if left:
            if left not in room:
                bisect.insort(free, left)
            room[left].append(b)
    return bins


def least_bins(lengths, capacity: int) -> int:
    """A lower bound on the bins: by the sum, and by what can't share a bin with pieces over half of it (for each bound k on small ones)."""
    size = np.asarray(lengths, np.int64)
    count = np.bincount(size, minlength=capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    alone, large = n[-1] - n[capacity - k], n[capacity - k] - n[half]
    spare = large * capacity - (total[capacity - k] - total[half])
    small = total[half] - np.where(k > 0, total[np.maximum(k, 1) - 1], 0)
    return int(max(-(-int(total[-1]) // capacity), (alone + large + np.maximum(0, -(-(small - spare) // capacity))).max()))


class _Bin:
    """Items by size; bit s of `ones` (`twos`) is set where an item (two items) of that size (sum) is there."""

    def __init__(self, items: list[int], size: list[int]):
        self.by: dict[int, list[int]] = defaultdict(list)
        for i in items:
            self.by[size[i]].append(i)
        self.fill, self.changed = sum(size[i] for i in items), 0
        self.mark()

    def mark(self) -> None:
        self.by = defaultdict(list, {s: x for s, x in self.by.items() if x})
        self.ones = sum(1 << s for s in self.by)
        self.twos = 0
        for s, x in self.by.items():  # a bin has few different sizes, as they add up to its fill at most
            self.twos |= (self.ones ^ (1 << s)) << s | (len(x) > 1) << 2 * s

    def two(self, total: int) -> list[int]:
        s = next(s for s, x in self.by.items() if (t := total - s) in self.by and (t != s or len(x) > 1))
        return [s, total - s]


def _smear(bits: int, most: int) -> int:
    """The bits, lowered by 1 to `most`."""
    out, span = bits >> 1, 1
    while span < most:
        step = min(span, most - span)
        out |= out >> step
        span += step
    return out


def _step(a: _Bin, b: _Bin, capacity: int) -> bool:
    """Exchange at most two items of a for at most two of b (three in all) so that b gains as much as it can, if it can."""
    for d in range(capacity - b.fill, 0, -1):
        if hit := a.ones >> d & (b.ones | 1):
            back = [hit.bit_length() - 1] if hit > 1 else []
            out = [d + sum(back)]
        elif hit := a.ones >> d & b.twos:
            back, out = b.two(hit.bit_length() - 1), [d + hit.bit_length() - 1]
        elif hit := a.twos >> d & (b.ones | 1):
            back, out = [hit.bit_length() - 1] if hit > 1 else [], a.two(d + hit.bit_length() - 1)
        else:
            continue
        gone, come = [a.by[s].pop() for s in out], [b.by[s].pop() for s in back]
        for s, i in zip(out, gone):
            b.by[s].append(i)
        for s, i in zip(back, come):
            a.by[s].append(i)
        a.fill, b.fill = a.fill - d, b.fill + d
        a.mark()
        b.mark()
        return True
    return False


def local_search(bins: list[list[int]], size: list[int], capacity: int, need: int | None = None) -> list[list[int]]:
    """Raise the sum of squared fills between underfull bins until there are `need` (by default the lower bound) or no step is left.

    The less filled of two bins gives: any net amount that the fuller one takes raises the
    sum. Pairs that had no step are looked at again only after one of them has changed.
    """
    need = least_bins([size[i] for b in bins for i in b], capacity) if need is None else need
    made = [_Bin(b, size) for b in bins]
    used, clock, looked, again = sum(b.fill > 0 for b in made), 1, {}, True
    while again and used > need:
        again = False
        for giver in sorted((b for b in made if 0 < b.fill < capacity), key=lambda b: b.fill):
            since = looked.get(id(giver), 0) if giver.changed < looked.get(id(giver), 0) else 0
            start = clock = clock + 1
            reach: dict[int, tuple[int, int]] = {}
            for taker in sorted((b for b in made if giver.fill <= b.fill < capacity and b is not giver and b.changed >= since), key=lambda b: -b.fill):
                while giver.fill and taker.fill < capacity and taker.fill >= giver.fill:
                    gap = capacity - taker.fill
                    if gap not in reach:
                        reach[gap] = _smear(giver.ones, gap), _smear(giver.twos, gap)
                    one, two = reach[gap]
                    if not (one & (taker.ones | taker.twos | 1) or two & (taker.ones | 1)) or not _step(giver, taker, capacity):
                        break
                    clock, again, reach = clock + 1, True, {}
                    giver.changed = taker.changed = clock
                if not giver.fill:
                    used -= 1
                    break
            if giver.changed < start:
                looked[id(giver)] = start
            if used <= need:
                break
    return [[i for x in b.by.values() for i in x] for b in made if b.fill]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices of `lengths`."""
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order].tolist()
    bins = best_fit_decreasing(falling, capacity)
    if len(bins) > (need := least_bins(falling, capacity)):
        bins = local_search(bins, falling, capacity, need)
    return [[int(order[i]) for i in b] for b in bins]


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, with the checksum of their ids as unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        enc = wordpiece.encoder(tokenizer)
        for batch in batches:
            out = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(enc.encode(text), enc.kind).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    piece = ids[a : a + capacity]
                    out.append((d, k, a, len(piece), zlib.crc32(piece.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 5, schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, PIECES)


def _dealt(pieces: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """Pieces with sequence_id, offset and fill (their sequence's), packed in so many groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        seq, off, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, b in enumerate(pack_lengths(lengths, capacity)):
            seq[b] = (turn << 56) + (int(pdf["grp"].iloc[0]) << 32) + k
            ends = np.cumsum(lengths[b])
            off[b], fill[b] = ends - lengths[b], ends[-1]
        return pdf.drop(columns="grp").assign(sequence_id=seq, offset=off, fill=fill)

    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(groups)))
    return grouped.groupBy("grp").applyInPandas(run, PACKED + ", fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset. `pieces` should be materialised: it is counted, then dealt into groups.

    Pieces of equal id, number and checksum (repeated rows) go to one group; they are light.
    """
    spark, done, turn = pieces.sparkSession, [], 0
    groups = max(1, -(-pieces.count() // group_pieces))
    packed = _dealt(pieces, groups, turn, capacity)
    while groups > 1:  # each group leaves one sequence that is at most half full
        packed = common.materialise(packed, common.shared_dir(spark, "packed"))
        half = F.col("fill") * 2 <= capacity
        done.append(packed.filter(~half))
        loose = packed.filter(half).drop("sequence_id", "offset", "fill")
        left = max(1, -(-loose.count() // group_pieces))
        packed, groups, turn = _dealt(loose, min(left, groups - 1), turn + 1, capacity), min(left, groups - 1), turn + 1
    for d in done:
        packed = packed.unionByName(d)
    return packed.drop("fill")


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Cut and pack all documents; encoding happens once, its result is kept in the shared folder."""
    spark = docs.sparkSession
    pieces = common.materialise(cut(docs, tokenizer, capacity), common.shared_dir(spark, "pieces"))
    return pack(pieces, capacity, group_pieces)
