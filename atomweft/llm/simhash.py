"""SimHash near-duplicates by anchor-point covering.

A fingerprint's bit is set where over half the shingles' XXH64 (seed 42) have it. Two
fingerprints that differ in at most 4 of 64 bits differ in at most 1 of the first 31 bits or
in at most 2 of the other 33. Each of these two blocks has a covering code as anchors: the
perfect Hamming (31, 26) code on 31 bits, with every value of the rest, so each block value
has one anchor within the covering radius 1, its home. Every fingerprint is replicated to all
anchors within radius plus threshold (2 bits, 16 anchors, and 3 bits, 189 anchors, found from
the syndrome), so of two linked fingerprints each meets the other at its home in one of the
blocks. Per anchor, those at home are compared with all. There are 2^26 and 2^28 anchors, so
an anchor's share of the fingerprints, and with it the comparisons, stay small at any size.

Equal fingerprints are one before all this, so copies cost nothing. An anchor's task keeps a
spanning forest of its links, never all pairs. Anchors with more than `group` fingerprints
are cut into chunks, and each pair of chunks is a task of its own; which anchors are that
large is estimated from one fingerprint in `PROBE`, which settles the tasks' sizes only: with
any choice every pair meets. Components are found by alternating stars in shared storage.

Null and empty texts have fingerprint zero and are linked like any other. Fewer words than a
shingle: the whole sequence is the only shingle. Null doc_ids are kept, a component of only
nulls has a null id. An empty table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import itertools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, joined_anew

SHINGLE = 4
DISTANCE = 4
SEED = 42
GROUP = 131_072
PROBE = 64
BLOCKS = ((0, 31, 1), (31, 33, 2))  # first bit, bits, threshold; the thresholds, each plus one, add up to DISTANCE + 1
HAMMING = 31
SPREAD = 16_384  #: fingerprints a task of those that are replicated
MOST_TASKS = 65_536
TASK_ROWS = 400_000  #: gathered before they are compared
CELLS = 4_000_000  #: comparisons made at once
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number."""
    import xxhash

    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = np.array([digest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends])[: len(words) - shingle + 1]
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 4096):
        ones += np.unpackbits(h[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def tag_of(text: str):
    return F.xxhash64(common.text_or_empty(text)).alias("tag")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, a tag of the text and fp (the fingerprint's bits as a long)."""

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got.view(np.int64))], names=["doc_id", "tag", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag_of("text"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tag long, fp long")


def syndrome(v: np.ndarray) -> np.ndarray:
    """Of the Hamming part: the position (from 1) of the bit that is off the code, or 0."""
    out = np.zeros(len(v), np.uint64)
    for b in range(HAMMING):
        out ^= np.where((v >> np.uint64(b)) & np.uint64(1), np.uint64(b + 1), np.uint64(0))
    return out


@functools.cache
def flips(most: int) -> list[np.ndarray]:
    """By syndrome: the bit masks of the Hamming part that lead to a code word in at most `most` flips."""
    out: list[list[int]] = [[] for _ in range(HAMMING + 1)]
    for n in range(most + 1):
        for chosen in itertools.combinations(range(1, HAMMING + 1), n):
            out[functools.reduce(operator.xor, chosen, 0)].append(sum(1 << (c - 1) for c in chosen))
    return [np.array(x, np.uint64) for x in out]


def anchors(fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, key of the anchor, whether it is the home) for all anchors within radius plus threshold in a block."""
    if distance > sum(t + 1 for *_, t in BLOCKS) - 1:
        raise ValueError(f"the blocks' thresholds cover at most {sum(t + 1 for *_, t in BLOCKS) - 1} bits")
    index, keys, homes = [], [], []
    for block, (first, bits, threshold) in enumerate(BLOCKS):
        v = (fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        s = syndrome(v).astype(np.int64)
        home = v ^ np.where(s > 0, np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64), np.uint64(0))
        for n_free in range(min(threshold + 1, bits - HAMMING) + 1):
            ways = flips(threshold + 1 - n_free)
            count = np.array([len(w) for w in ways])[s]
            which = np.repeat(np.arange(len(fp)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            starts = np.cumsum([0, *map(len, ways)])
            code = v[which] ^ np.concatenate(ways)[starts[s[which]] + nth]
            for free in itertools.combinations(range(HAMMING, bits), n_free):
                anchor = code ^ np.uint64(sum(1 << f for f in free))
                index.append(which)
                keys.append(anchor | np.uint64(block << 40))
                homes.append(anchor == home[which])
    return np.concatenate(index), np.concatenate(keys), np.concatenate(homes)


def replicate(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(anchor, home, fp) of distinct fingerprints."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if len(fp):
                i, key, home = anchors(fp, distance)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(home), pa.array(fp[i].view(np.int64))], names=["anchor", "home", "fp"])

    return distinct.select("fp").mapInArrow(run, "anchor long, home boolean, fp long")


def forest(fp: np.ndarray, group: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that span what is linked within each group; rows are sorted by group."""
    label = np.arange(len(fp))
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(edges, len(group)))

    def join(a, b):
        while len(a):
            la, lb = label[a], label[b]
            m = np.minimum(la, lb)
            np.minimum.at(label, la, m)
            np.minimum.at(label, lb, m)  # roots only: a member keeps to its root, which may have gone to a lesser one
            while (label != label[label]).any():
                label[:] = label[label]
            left = label[a] != label[b]
            a, b = a[left], b[left]

    small = np.repeat(sizes <= 128, sizes)
    at = np.flatnonzero(small)
    for k in range(1, int(sizes[sizes <= 128].max(initial=1))):
        at = at[at + k < len(fp)]
        at = at[group[at] == group[at + k]]
        if not len(at):
            break
        near = (np.bitwise_count(fp[at] ^ fp[at + k]) <= distance) & (home[at] | home[at + k])
        join(at[near], at[near] + k)
    for a, n in zip(edges[sizes > 128].tolist(), sizes[sizes > 128].tolist()):
        at_home, step = a + np.flatnonzero(home[a : a + n]), max(1, CELLS // n)
        for c in range(0, len(at_home), step):
            x = at_home[c : c + step]
            i, j = np.nonzero(np.bitwise_count(fp[x, None] ^ fp[None, a : a + n]) <= distance)
            join(x[i], a + j)
    hung = np.flatnonzero(label != np.arange(len(fp)))
    return fp[hung], fp[label[hung]]


def links(distinct: DataFrame, distance: int = DISTANCE, group: int = GROUP, probe: int = PROBE) -> DataFrame:
    """Links (u, v) whose components are those of all links between distinct fingerprints."""
    spark = distinct.sparkSession
    met = replicate(distinct.repartition(max(1, min(MOST_TASKS, distinct.count() // SPREAD)), "fp"), distance)
    some = replicate(distinct.filter(F.pmod(F.xxhash64("fp", F.lit("probe")), F.lit(probe)) == 0), distance)
    sized = some.groupBy("anchor").agg((F.count("*") * probe).alias("n")).filter(F.col("n") > max(probe, group // 2))
    hot = common.materialise(sized, common.shared_dir(spark, "anchors"))
    if hot.isEmpty():
        met = met.select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "home", "fp")
    else:
        met = met.join(hot, "anchor", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("n") * 2 / group), F.lit(1)).cast("int"))
        met = met.withColumn("c", F.pmod(F.xxhash64("fp"), "chunks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        met = met.select("anchor", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "home", "fp")

    def run(batches):
        held, n, most = [], 0, TASK_ROWS
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
            n += len(held[-1][0])
            if n >= most:  # all groups but the last are whole
                rows = [np.concatenate(p) for p in zip(*held)]
                other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                yield from out([x[:cut] for x in rows])
                held, n = [[x[cut:] for x in rows]], n - cut
                most = max(TASK_ROWS, 2 * n)
        if held:
            yield from out([np.concatenate(p) for p in zip(*held)])

    def out(rows):
        anchor, i, j, home, fp = rows
        if len(fp):
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            u, v = forest(fp.view(np.uint64), np.cumsum(new), home.astype(bool), distance)
            if len(u):
                pairs = np.unique(np.stack([u, v]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], names=["u", "v"])

    dealt = met.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return dealt.mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, tag, fp, root (the component's least fingerprint) and component_id: the smallest doc_id reachable over links."""
    spark = docs.sparkSession
    marked = common.materialise(fingerprints(docs, shingle), common.shared_dir(spark, "fingerprints"))
    distinct = common.materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), common.shared_dir(spark, "distinct"))
    roots = components(links(distinct, distance)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = joined_anew(rooted.select("fp", "root"), least, "root").select("fp", "root", "component_id")
    return marked.join(ids, "fp").select("doc_id", "tag", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each component: the smallest doc_id (null last), of repeated ids the text with the least tag.

    Survivors are chosen by component, so components of rows without ids, or whose ids occur
    in others too, each keep one. Rows equal in id and text are one row afterwards.
    """
    found = classes(docs, shingle, distance).groupBy("root", "doc_id", "tag").agg(F.count("*").alias("n"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag", "n")).alias("k"))
    kept = first.select(F.coalesce("k.doc_id", F.lit(0)).alias("__i"), F.col("k.last").alias("__null"), F.col("k.tag").alias("__t"), (F.col("k.n") > 1).alias("__many"))
    id_ = F.col("doc_id").cast("long")
    rows = docs.withColumns({"__i": F.coalesce(id_, F.lit(0)), "__null": id_.isNull(), "__t": tag_of("text")}).join(kept, ["__i", "__null", "__t"])
    once, many = rows.filter(~F.col("__many")), rows.filter(F.col("__many"))
    return once.select(*docs.columns).unionByName(many.dropDuplicates(["__i", "__null", "__t"]).select(*docs.columns))
