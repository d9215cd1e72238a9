"""Hierarchical language identification by linear support vector machines.

First the language family, then one-versus-one machines between the languages within it.
Features are hashed byte trigrams of the lower-cased whole text, square-rooted and of unit
length. Machines are fitted on at most `SAMPLE` labelled documents, drawn by a hash of id
and text and shared evenly among the languages (a documented bound on training, at most twice
as many where equal rows are drawn together; prediction covers all documents). Ties go to the language first in code-point order.

Null text, or text without a letter: `und` with score 0. The same holds for all documents if
nothing is labelled. One known language is predicted wherever there is a letter. Null lang is
no label; null doc_id is hashed as empty. Further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 4096
SAMPLE = 2400
UNKNOWN = "und"
LEAST = 0.25
FAMILY = dict.fromkeys("en de nl sv da nb no is af fy lb yi".split(), "germanic") | dict.fromkeys("fr es it pt ro ca gl oc la".split(), "romance") | dict.fromkeys("ru uk be pl cs sk bg sr hr sl mk".split(), "slavic")


def features(text: str) -> np.ndarray:
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = np.zeros(DIM, np.float32)
    for a in range(0, len(b) - 2, 1 << 20):
        c = b[a : a + (1 << 20) + 2]
        key = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        out += np.bincount(key, minlength=DIM)
    out = np.sqrt(out)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of an L1-loss linear machine by dual coordinate descent over some rows of x; y is +1 or -1.

    Rows have unit length; the bias is a further feature of 1, which is not stored.
    """
    w, a = np.zeros(x.shape[1] + 1, np.float32), np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            row = x[rows[i]]
            new = min(max(a[i] - (y[i] * float(row @ w[:-1] + w[-1]) - 1) / 2.0, 0.0), c)
            if (d := new - a[i]) != 0:
                w[:-1] += np.float32(d * y[i]) * row
                w[-1] += d * y[i]
                a[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    languages: list[str]
    families: dict[str, list[str]]
    machines: dict[tuple[str, str], np.ndarray]  #: by pair of families ("#a", "#b") or of languages

    def _vote(self, names: list[str], x: np.ndarray, mark: str) -> tuple[str, float]:
        won, least = dict.fromkeys(names, 0), dict.fromkeys(names, 50.0)
        for k, a in enumerate(names):
            for b in names[k + 1 :]:
                w = self.machines[mark + a, mark + b]
                m = float(x @ w[:-1] + w[-1])
                won[a if m >= 0 else b] += 1
                least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = max(names, key=lambda n: (won[n], least[n]))  # the first of equals
        return best, 1 / (1 + np.exp(-2 * least[best]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, p = self._vote(sorted(self.families), x, "#")
        lang, q = self._vote(self.families[family], x, "")
        return lang, float(p * q)


def fit(langs: list[str], x: np.ndarray) -> Model:
    names = sorted(set(langs))
    families: dict[str, list[str]] = {}
    for n in names:
        families.setdefault(FAMILY.get(n.split("-")[0].lower(), n), []).append(n)
    of = {n: f for f, ns in families.items() for n in ns}
    lang, fam, machines = np.array(langs), np.array([of[n] for n in langs]), {}

    def pairs(labels, ns, mark):
        for k, a in enumerate(ns):
            for b in ns[k + 1 :]:
                rows = np.flatnonzero((labels == a) | (labels == b))
                machines[mark + a, mark + b] = svm(x, rows, np.where(labels[rows] == a, 1, -1))

    pairs(fam, sorted(families), "#")
    for ns in families.values():
        pairs(lang, ns, "")
    return Model(names, families, machines)


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on rows (doc_id, text, lang). Languages are counted first, then each is sampled at its own rate."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], {}, {})
    share = max(1, sample // len(counts))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rates = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, share / n))])
    chosen = known.filter(draw < rates[F.col("lang")]).select("lang", F.col("text").cast("string").alias("text"))
    if sum(counts.values()) > sample:  # equal rows are drawn together, so the bound on what the driver gets is set apart
        chosen = chosen.orderBy(F.xxhash64("text", "lang")).limit(2 * sample)

    def run(batches):
        for batch in batches:
            rows = [(g, features(t).astype("<f2").tobytes()) for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "x"])

    rows = sorted(tuple(r) for r in chosen.mapInArrow(run, "lang string, x binary").collect())  # about `sample` rows, by the rates
    if not rows:
        return Model([], {}, {})
    x = np.empty((len(rows), DIM), np.float32)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(r[1], "<f2")
    return fit([r[0] for r in rows], x)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document; the model's size depends on the number of languages only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The documents that are not `und` and whose score is at least `least`, with all their columns.

    A family, and a language within it, that beats all others has at least a half each; so what
    goes besides documents without a letter are those for which the machines contradict each
    other. Where nothing was labelled, all documents with a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keeps(text: str | None) -> bool:
        if not shared.value.languages:
            return has_letter(text)
        lang, score = shared.value.predict(text)
        return lang != UNKNOWN and score >= least

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        return text.map(keeps).astype(bool)

    return docs.filter(kept(F.col("text").cast("string")))
