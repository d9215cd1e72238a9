"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is cut into units: words, in pieces of up to 4 code points, and single code points of
scripts that write without spaces. A k-mer of 5 units is chosen as an anchor if the least of
its units, by hash, is its first or its last. That depends on the k-mer alone, so texts that
share a passage choose the same anchors in it, wherever it stands, and of any four k-mers in
a row at least one is chosen. Texts of all lengths have the same units, so any two can be
compared. A fingerprint is all of a text's anchors in order, each as the distance from the one
before, in units, and a 32-bit hash: places and hashes can be read back from it. Likeness
matches by position: an anchor counts with the next one and the distance to it, and the
likeness is the Jaccard index of the distinct such links of two fingerprints.

A text with units but no anchor (fewer than 5) has one for the whole. Null, empty and blank
texts have none: an empty fingerprint, like another empty one by 1 and any other by 0. Ties of
doc_id go by the text's hash; an empty table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

K = 5
PIECE = 4
_BLANK = r"\x20\x09-\x0D"
#: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han: written without spaces.
_SOLID = r"\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
UNIT = f"[^{_BLANK}{_SOLID}]{{1,{PIECE}}}|[^{_BLANK}]"
BUCKET_DOCS = 1024
BUCKET_PROBES = 64  #: ids a bucket that the bounds are chosen from
MOST_BUCKETS = 262_144  #: the bounds are part of the plan; beyond a thousand million documents buckets grow
LOW = 0xFFFFFFFF


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def _place(x: Column) -> Column:
    return F.shiftright(x, 32)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: the anchors of a text, in order, as longs: place << 32 | hash, places counted in units."""
    h, n = F.col("__h"), F.col("__n")
    inner = lambda i: F.least(*[F.get(h, i + d) for d in range(1, K - 1)])
    chosen = F.filter(F.sequence(F.lit(0), n - K), lambda i: (F.get(h, i) <= inner(i)) | (F.get(h, i + (K - 1)) <= inner(i)))
    df = df.withColumn("__h", F.transform(F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(0)), lambda x: F.xxhash64(x))).withColumn("__n", F.size("__h"))
    df = df.withColumn("__at", F.when(n >= K, chosen).otherwise(F.array().cast("array<int>")))
    anchors = F.transform("__at", lambda at: F.shiftleft(at.cast("long"), 32).bitwiseOR(_low(F.xxhash64(*[F.get(h, at + d) for d in range(K)]))))
    df = df.withColumn(out, F.when(F.size("__at") > 0, anchors).when(n > 0, F.array(_low(F.xxhash64(h)))).otherwise(F.array().cast("array<bigint>")))
    return df.drop("__h", "__n", "__at")


def links(fingerprint: str) -> Column:
    """Distinct hashes of each anchor with the next and the distance to it; of a single anchor itself."""
    f = F.col(fingerprint)
    pair = lambda x, i: F.xxhash64(_low(x), F.get(f, i + 1) - F.shiftleft(_place(x), 32))
    return F.when(F.size(f) < 2, f).otherwise(F.array_distinct(F.slice(F.transform(f, pair), F.lit(1), F.greatest(F.size(f) - 1, F.lit(0)))))


def likeness(a: str, b: str) -> Column:
    """The share of the links of both (columns made by `links`) that both have."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def places(fingerprint: Column) -> Column:
    """The anchors as structs (hash, at) by hash: of each hash the first place only."""
    placed = F.sort_array(F.transform(fingerprint, lambda x: F.struct(_low(x).alias("hash"), _place(x).alias("at"))))
    return F.filter(placed, lambda x, i: (i == 0) | (F.get(placed, i - 1)["hash"] != x["hash"]))


def matches(a: Column, b: Column) -> Column:
    """Where two fingerprints have equal anchors: structs (at, other), of each hash the first places in both.

    Both are sorted by hash together, so equal ones are neighbours.
    """
    side = lambda p, s: F.transform(places(p), lambda x: F.struct(x["hash"].alias("hash"), F.lit(s).alias("side"), x["at"].alias("at")))
    both = F.sort_array(F.concat(side(a, 0), side(b, 1)))
    found = F.transform(both, lambda x, i: F.when((i > 0) & (F.get(both, i - 1)["hash"] == x["hash"]), F.struct(F.get(both, i - 1)["at"].alias("at"), x["at"].alias("other"))))
    return F.sort_array(F.filter(found, lambda m: m.isNotNull()))


def written(fingerprint: str) -> Column:
    """Nine hexadecimal digits an anchor: one for the distance from the one before (of the first: from -1), which is 1 to 5, and eight for the hash."""
    f = F.col(fingerprint)
    before = lambda i: F.coalesce(_place(F.get(f, i - 1)), F.lit(-1))
    return F.lower(F.array_join(F.transform(f, lambda x, i: F.hex(x - F.shiftleft(before(i), 32))), ""))


def with_next(docs: DataFrame, carried: list[str], dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs (with __id, never null) plus next_<c> of the next row by __id; after the last comes the first.

    `dealt` adds columns after the shuffle, so they are not shuffled.

    One shuffle: rows go to contiguous buckets of ids, bounded by ids that occur (from a
    hash sample, as bounds settle the buckets' sizes only). A bucket's first id also visits
    the bucket before, the least id visits the last. Equal ids are in the order of their
    text's hash.
    """
    ids = docs.select("__id")
    low, n = ids.agg(F.min("__id"), F.count("*")).first()
    parts = max(1, min(MOST_BUCKETS, -(-n // BUCKET_DOCS)))
    some = ids.filter(F.pmod(F.xxhash64("__id", F.lit("cut")), F.lit(max(1, n // (parts * BUCKET_PROBES)))) == 0)  # any bounds will do, these are even
    found = some.agg(F.percentile_approx("__id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    cuts = sorted({*(found or [])} - {low})
    bounds = (F.split(F.lit(",".join(map(str, cuts))), ",") if cuts else F.array()).cast("array<bigint>")
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]).cast("array<int>")
    bucket = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col("__id"), at + step).otherwise(at))
    visit = lambda to, rank: F.struct(to.cast("int").alias("bucket"), F.lit(rank).alias("guest"))
    places = F.array(visit(F.col("__own"), 0), F.when(F.get(bounds, F.col("__own") - 1) == F.col("__id"), visit(F.col("__own") - 1, 1)), F.when(F.col("__id") == F.lit(low), visit(F.lit(len(cuts)), 2)))
    rows = docs.withColumn("__own", bucket).withColumn("__p", F.explode(F.filter(places, lambda p: p.isNotNull())))
    rows = rows.withColumns({"__bucket": F.col("__p.bucket"), "__guest": F.col("__p.guest")}).drop("__own", "__p")
    rows = dealt(rows.repartition("__bucket"))
    order = Window.partitionBy("__bucket").orderBy("__guest", "__id", "__tie")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return rows.filter("__guest = 0").drop("__bucket", "__guest")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, links and next_links, and the edited text.

    The last quarter of a text gives way to as much of the beginning of the next document's.
    """
    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    rows = rows.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("__tie", F.xxhash64("text"))
    made = lambda df: with_fingerprint(df, "text", "fingerprint").withColumn("links", links("fingerprint"))
    rows = with_next(rows, ["text", "links"], made)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "links", "next_links", text.alias("edited"))


def digest(docs: DataFrame) -> DataFrame:
    rows = with_fingerprint(edited(docs), "edited", "edited_fingerprint")
    rows = rows.withColumn("edited_links", links("edited_fingerprint"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written("fingerprint").alias("fingerprint"), written("edited_fingerprint").alias("edited_fingerprint"),
        likeness("links", "edited_links").alias("near_edited"), likeness("links", "next_links").alias("near_next"),
    )
