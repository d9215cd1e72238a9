"""Quality rules: whole-text statistics and a learned decision list over them.

Sequential covering: a rule is a conjunction of thresholds, grown greedily by information
gain on two thirds of the labelled documents until it covers no good one there or no test
helps, pruned on the rest, and kept if it is precise on both (`PRECISION`) and covers at least
`LEAST` bad documents; what it covers is set aside and the next rule is sought, until one
isn't kept. The list becomes one ordered Spark conditional expression; a document that no
rule covers is kept. Learning uses about `SAMPLE` labelled documents, at most twice as many,
drawn by a hash (a documented bound on training only).

Null text has no words. Null or repeated labels: null quality is no label, of several labels
of a document the least counts. Without labels the list is empty and keeps everything.
Repeated documents each get their row; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
PRECISION = 0.95
LEAST = 8  #: bad documents that a rule must cover
MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_alpha", "n_upper", "n_digits", "n_marks", "n_lines")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
_SPACE = b" \t\n\v\f\r"
_OTHER = {s: bytes(b for b in range(256) if b not in s) for s in (b"#*$%&|<>", b"0123456789", b".,;:!?", bytes(range(65, 91)))}


def _count(text: bytes, which: bytes) -> int:
    return len(text.translate(None, _OTHER[which]))


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The counts of a UTF-8 text, in the order of COUNTS."""
    text = text or b""
    words = text.split()
    chars = len(text.translate(None, _SPACE)) if text.isascii() else len(text.decode("utf-8", "replace").translate(dict.fromkeys(_SPACE)))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    repeat = 0
    if len(words) > 2:
        seen = Counter(zip(words, words[1:], words[2:]))
        if len(seen) < len(words) - 2:
            last = -1
            for i, window in enumerate(zip(words, words[1:], words[2:])):
                if seen[window] > 1:
                    repeat += i + 3 - max(i, last)
                    last = i + 3
    alpha = sum(map(bytes.isalpha, words))
    return len(words), chars, _count(text, b"#*$%&|<>"), len(lines) - len(set(lines)), repeat, len(set(words)), alpha, _count(text, bytes(range(65, 91))), _count(text, b"0123456789"), _count(text, b".,;:!?"), len(lines)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every document."""

    def run(batches):
        for batch in batches:
            got = [statistics(t) for t in batch.column(1).to_pylist()]
            cols = zip(*got) if got else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, STATS)


def ratios(c) -> dict:
    """What rules test, from columns or arrays by name; the same expressions serve learning and Spark."""
    words, lines, chars = c["n_words"] + 1.0, c["n_lines"] + 1.0, c["word_chars"] + 1.0
    return {
        "symbols a word": c["n_symbols"] / words,
        "repeated lines": c["n_dup_lines"] / lines,
        "repeated words": c["n_repeat_words"] / words,
        "distinct words": c["n_distinct"] / words,
        "characters a word": c["word_chars"] / words,
        "plain words": c["n_alpha"] / words,
        "capitals": c["n_upper"] / chars,
        "digits": c["n_digits"] / chars,
        "marks a word": c["n_marks"] / words,
        "words a line": c["n_words"] / lines,
    }


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    bound: float

    def holds(self, x):
        return x[self.name] > self.bound if self.above else x[self.name] <= self.bound


def _covers(rule, x: dict, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _grow(x: dict, bad: np.ndarray) -> list[Test]:
    """Add the threshold with the highest gain until no good document is covered."""
    rule: list[Test] = []
    at = np.ones(len(bad), bool)
    while (at & ~bad).any():
        p, n = int((at & bad).sum()), int(at.sum())
        best, gain = None, 1e-9
        for name in x:
            order = np.flatnonzero(at)[np.argsort(x[name][at], kind="stable")]
            v, cum = x[name][order], np.cumsum(bad[order])
            ends = np.flatnonzero(v[1:] > v[:-1])
            if not len(ends):
                continue
            for above, pos, size in ((False, cum[ends], ends + 1), (True, p - cum[ends], n - ends - 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / size) - np.log2(p / n)), 0)
                if g[k := int(np.argmax(g))] > gain:
                    best, gain = Test(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)), g[k]
        if best is None:
            break
        rule.append(best)
        at &= best.holds(x)
    return rule


def learn(x: dict, bad: np.ndarray, precision: float = PRECISION, least: int = LEAST) -> list[list[Test]]:
    """Ordered rules for bad documents; rows must be in a random order."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    while (left & bad).sum() >= least:
        grow = left & ~prune
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        check = left & prune

        def worth(r):
            hit = _covers(r, x, n) & check
            return (int((hit & bad).sum()) - int((hit & ~bad).sum())) / max(1, int(hit.sum()))

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(rule, x, n) & left if rule else np.zeros(n, bool)
        right = lambda part: (hit & bad & part).sum() >= precision * max(1, (hit & part).sum())  # noqa: B023, E731
        if (hit & bad).sum() < least or not right(prune) or not right(~prune):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Test]]:
    """Learn from measured documents with a quality label (0: bad)."""
    marks = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rate = min(1.0, sample / max(1, marks.count()))
    key = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30))
    rows = measured.join(marks.filter(key < int(rate * (1 << 30))), "doc_id").select(key.alias("key"), "doc_id", "quality", *COUNTS).limit(2 * sample).toPandas()
    if rows.empty:
        return []
    rows = rows.sort_values(["key", "doc_id", *COUNTS], ignore_index=True)
    x = {k: v.to_numpy() for k, v in ratios(rows).items()}
    return learn(x, rows["quality"].to_numpy() == 0)


def keeps(rules: list[list[Test]]) -> Column:
    """The list as an ordered conditional expression over COUNTS: false where a rule covers."""
    x = ratios({c: F.col(c) for c in COUNTS})
    out = None
    for rule in rules:
        hit = F.lit(True)
        for t in rule:
            hit = hit & t.holds(x)
        out = F.when(hit, False) if out is None else out.when(hit, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """measured with base_failed and kept."""
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & keeps(rules))
