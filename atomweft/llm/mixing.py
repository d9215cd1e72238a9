"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources by code point (null last) weigh 3, 1, 2 in turn and share `share` times all
words; none gets more than `cap` times its own words, the excess is reshared by weight.
The words are handed out in blocks: highest quotients target / (2 k + 1) give every source an
integer number of blocks, highest quotients by size then give every shard of a source its
quota. What the cap or the last block takes from or adds to a quota is made up for by the
source's other shards, in order, so a source gets its target to the word.

A shard is a hash class of a source's documents, by id and text, of about `SHARD_WORDS`; a
small source has one, a hot one many. Within a shard documents stand in a seeded order; the
quota is read off that stream of blocks, whole passes first and then its beginning, so at
most one document of a shard is taken in part. Places in the stream are prefix sums in two
steps, over 256 buckets of a shard and within each, so no task gathers a shard.

Nulls: null text has no words, null source is a source, null doc_id is hashed as empty. An
empty table gives no row. Repeated rows are mixed each on its own, their order among
themselves is any. Only doc_id, source and text are read; own columns begin with two
underscores, so others keep their names and values. The windows over sources hold one row a
source, not documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK = 64
SHARD_WORDS = 8_000_000
SEED = "mix-1"


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(common.WORD)).cast("long"), F.lit(0).cast("long"))


def _key(seed: str) -> Column:
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(seed + ":"), part("doc_id"), F.lit(":"), part("text")))


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, the number of words and the seeded key."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), _key(seed).alias("__key"))


def targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row a source: source, source_size, target. The windows run over sources, not documents."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    by_room = Window.orderBy(F.col("source_size") * cap / F.col("w"), "rank")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(share)
    room = F.col("source_size") * F.lit(cap)
    left = total - F.coalesce(F.sum(room).over(before), F.lit(0.0))
    per = per.withColumn("total", total).withColumn("full", left * F.col("w") >= room * F.sum("w").over(after))
    free = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), room)).over(every), F.lit(0.0))
    return per.withColumn("target", F.when(F.col("full"), room).otherwise(rest / free * F.col("w"))).select("rank", "source", "source_size", "target")


def _apportioned(q: DataFrame, by: list[str], votes: str, last: str, tries: Column) -> DataFrame:
    """q with `seats`: q0, changed where the highest (or, if q0 adds up to too much, lowest) quotients of each group say.

    q has q0 and d (the seats that are left, or too many). A candidate gets or loses at most `tries` of them.
    """
    j = F.explode(F.sequence(F.lit(0).cast("long"), tries - 1))
    of = Window.partitionBy(*by)
    more = q.filter("d > 0").withColumn("j", j).withColumn("quotient", F.col(votes) / (2 * (F.col("q0") + F.col("j")) + 1))
    more = more.withColumn("nth", F.row_number().over(of.orderBy(F.desc("quotient"), last, "j"))).filter("nth <= d")
    less = q.filter("d < 0").withColumn("j", j).filter("q0 > j").withColumn("quotient", F.col(votes) / (2 * (F.col("q0") - F.col("j")) - 1))
    less = less.withColumn("nth", F.row_number().over(of.orderBy("quotient", last, F.desc("j")))).filter("nth <= -d")
    keys = list(dict.fromkeys([*by, last]))
    change = more.select(*keys, F.lit(1).alias("__by")).unionByName(less.select(*keys, F.lit(-1).alias("__by"))).groupBy(*keys).agg(F.sum("__by").alias("__by"))
    return q.join(change, keys, "left").withColumn("seats", F.col("q0") + F.coalesce("__by", F.lit(0))).drop("__by")


def source_quotas(wanted: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of every source: rounding gives all but a few, the highest (or lowest) quotients settle the rest."""
    every = Window.partitionBy()
    q = wanted.withColumn("q0", F.floor(F.col("target") / block + 0.5))
    q = q.withColumn("d", F.floor(F.sum("target").over(every) / block + 0.5) - F.sum("q0").over(every))
    return _apportioned(q, [], "target", "rank", F.abs("d")).select("rank", "source", "source_size", "target", F.col("seats").alias("blocks"))


def cell_words(cells: DataFrame, block: int = BLOCK, cap: float = 2.0) -> DataFrame:
    """cells (rank, shard, cell, source_size, target, blocks) with `words`: the quota of each shard, which add up to the source's target.

    No shard's seats change by more than its share of the changes, each shard's rounding counted, and one.
    """
    of = Window.partitionBy("rank")
    q = cells.withColumn("q0", F.when(F.col("source_size") > 0, F.floor(F.col("blocks") * F.col("cell") / F.greatest("source_size", F.lit(1)) + 0.5)).otherwise(F.lit(0)))
    q = q.withColumn("d", F.col("blocks") - F.sum("q0").over(of)).withColumn("n", F.count("*").over(of))
    share = 1 + F.ceil((F.abs("d") + F.col("n")) * F.col("cell") / F.greatest("source_size", F.lit(1)))
    q = _apportioned(q, ["rank"], "cell", "shard", F.least(F.abs("d"), share))
    most = F.floor(F.col("cell") * F.lit(cap))
    q = q.withColumn("w0", F.least(F.col("seats") * block, most)).withColumn("room", most - F.col("w0"))
    before = of.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    q = q.withColumn("owed", F.floor(F.col("target") + 0.5) - F.sum("w0").over(of))
    give = F.least(F.col("room"), F.greatest(F.lit(0), F.col("owed") - F.coalesce(F.sum("room").over(before), F.lit(0))))
    take = F.least(F.col("w0"), F.greatest(F.lit(0), -F.col("owed") - F.coalesce(F.sum("w0").over(before), F.lit(0))))
    return q.select("rank", "shard", "cell", (F.col("w0") + F.when(F.col("owed") > 0, give).otherwise(-take)).alias("words"))


def mix(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, shard_words: int = SHARD_WORDS, rows: DataFrame | None = None) -> DataFrame:
    """Rows plus __source_size, __target, __full (whole passes), __part (words of a further, cut pass) and __taken.

    `sized` (materialised) is sizes() of all documents; `rows` are the same documents with
    `__source`, `__size`, `__key` and any other columns, or None: then those of `sized`.
    """
    spark = sized.sparkSession
    name = lambda source: [F.coalesce(source, F.lit("")).alias("__sk"), source.isNull().alias("__sn")]
    quotas = source_quotas(targets(sized, weights, share, cap), block)
    quotas = quotas.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(shard_words)))))
    quotas = common.materialise(quotas.select("*", *name(F.col("source"))), common.shared_dir(spark, "quotas"))
    if rows is None:
        rows = sized.select("*", F.col("source").alias("__source"), F.col("size").alias("__size"))
    carried = [c for c in rows.columns if c not in ("__source", "__size", "__key")]
    hexed = lambda at, n: F.conv(F.substring("__key", at, n), 16, 10).cast("long")

    def placed(df: DataFrame, source: str) -> DataFrame:
        df = df.select("*", *name(F.col(source))).join(quotas.select("__sk", "__sn", F.col("rank").alias("__rank"), F.col("shards").alias("__shards")), ["__sk", "__sn"])
        return df.withColumns({"__shard": hexed(1, 8) % F.col("__shards"), "__sub": hexed(9, 2)}).drop("__sk", "__sn", "__shards")

    subs = placed(sized, "source").groupBy("__rank", "__shard", "__sub").agg(F.sum("size").alias("__bucket"))
    cells = subs.groupBy(F.col("__rank").alias("rank"), F.col("__shard").alias("shard")).agg(F.sum("__bucket").alias("cell"))
    words = cell_words(cells.join(quotas.drop("__sk", "__sn", "shards"), "rank"), block, cap)
    words = words.join(quotas.select("rank", "source_size", "target"), "rank").toDF("__rank", "__shard", "__cell", "__words", "__source_size", "__target")
    stream = Window.partitionBy("__rank", "__shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, 0)
    based = subs.withColumn("__base", F.sum("__bucket").over(stream) - F.col("__bucket")).drop("__bucket").join(words, ["__rank", "__shard"])
    rows = placed(rows, "__source").join(based, ["__rank", "__shard", "__sub"])
    seeded = Window.partitionBy("__rank", "__shard", "__sub").orderBy(F.substring("__key", 9, 24), "__size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cell = F.greatest("__cell", F.lit(1))
    rows = rows.withColumn("__end", F.col("__base") + F.sum("__size").over(seeded)).withColumn("__full", F.floor(F.col("__words") / cell)).withColumn("__rest", F.col("__words") % cell)
    rows = rows.withColumn("__part", F.greatest(F.lit(0).cast("long"), F.least("__end", "__rest") - (F.col("__end") - F.col("__size"))))
    return rows.select(*carried, "__source_size", "__target", "__full", "__part", (F.col("__full") * F.col("__size") + F.col("__part")).alias("__taken"))


def mix_documents(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document: texts are read once, their sizes kept in the shared folder."""
    rows = mix(common.materialise(sizes(docs, seed), common.shared_dir(docs.sparkSession, "sizes")), **how)
    return rows.select("doc_id", "source", "size", *[F.col(f"__{c}").alias(c) for c in ("source_size", "target", "taken")])


def mixed_texts(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The mix itself, in the columns of `docs`: a row for each whole pass, and one for a cut pass with the first words of the text."""
    sized = common.materialise(sizes(docs, seed), common.shared_dir(docs.sparkSession, "sizes"))
    rows = mix(sized, rows=docs.withColumns({"__source": F.col("source").cast("string"), "__size": _size(), "__key": _key(seed)}), **how)
    copies = F.concat(F.array_repeat(F.lit(False), F.col("__full").cast("int")), F.when(F.col("__part") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = rows.withColumn("__cut", F.explode(copies))
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # a word and the white space after it
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    text = F.when(F.col("__cut"), F.array_join(F.slice(pieces, F.lit(1), (F.col("__part") + lead).cast("int")), "")).otherwise(F.col("text"))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def _changes(q: str, by: str, votes: str, last: str, tries: str) -> str:
    """Common table expressions t_<q> and c_<q>: the seats that rows of q gain or lose."""
    over = f"PARTITION BY {by} ORDER BY" if by else "ORDER BY"
    key = f"{by}, {last}" if by else last
    return f"""t_{q} AS (SELECT *, unnest(range(CAST({tries} AS BIGINT))) AS j FROM {q}),
c_{q} AS (SELECT {key}, CAST(sum(chg) AS BIGINT) AS chg FROM (
  SELECT {key}, 1 AS chg FROM (SELECT *, row_number() OVER ({over} {votes} / CAST(2 * (q0 + j) + 1 AS DOUBLE) DESC, {last}, j) AS nth FROM t_{q} WHERE d > 0) WHERE nth <= d
  UNION ALL
  SELECT {key}, -1 FROM (SELECT *, row_number() OVER ({over} {votes} / CAST(2 * (q0 - j) - 1 AS DOUBLE), {last}, j DESC) AS nth FROM t_{q} WHERE d < 0 AND q0 > j) WHERE nth <= -d) GROUP BY {key})"""


SQL = rf"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
   md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w, source_size * 2e0 AS room, (SELECT sum(source_size) FROM per) * 1.5e0 AS total FROM per),
filled AS (SELECT *, (total - coalesce(sum(room) OVER (ORDER BY room / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) * w
   >= room * sum(w) OVER (ORDER BY room / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM weighed),
wanted AS (SELECT rank, source, source_size, CASE WHEN is_full THEN room ELSE (total - coalesce((SELECT sum(room) FROM filled WHERE is_full), 0e0)) / (SELECT sum(w) FROM filled WHERE NOT is_full) * w END AS target FROM filled),
q1 AS (SELECT *, CAST(floor(target / 64 + 0.5e0) AS BIGINT) AS q0, CAST(floor((SELECT sum(target) FROM wanted) / 64 + 0.5e0) AS BIGINT) - CAST((SELECT sum(floor(target / 64 + 0.5e0)) FROM wanted) AS BIGINT) AS d FROM wanted),
{_changes("q1", "", "target", "rank", "abs(d)")},
quotas AS (SELECT q1.rank, source, source_size, target, q0 + coalesce(chg, 0) AS blocks, greatest(1, CAST(ceil(source_size / 8000000.0) AS BIGINT)) AS shards FROM q1 LEFT JOIN c_q1 USING (rank)),
spread AS (SELECT s.*, rank, CAST('0x' || substr(key, 1, 8) AS BIGINT) % shards AS shard FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source),
cells AS (SELECT rank, shard, CAST(sum(size) AS BIGINT) AS cell FROM spread GROUP BY 1, 2),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(blocks * cell / CAST(source_size AS DOUBLE) + 0.5e0) AS BIGINT) ELSE 0 END AS q0 FROM cells JOIN quotas USING (rank)),
q2 AS (SELECT *, blocks - CAST(sum(q0) OVER (PARTITION BY rank) AS BIGINT) AS d, count(*) OVER (PARTITION BY rank) AS n FROM shares),
{_changes("q2", "rank", "cell", "shard", "least(abs(d), 1 + ceil((abs(d) + n) * cell / CAST(greatest(source_size, 1) AS DOUBLE)))")},
seated AS (SELECT q2.*, least(CAST((q0 + coalesce(chg, 0)) * 64 AS BIGINT), 2 * cell) AS w0 FROM q2 LEFT JOIN c_q2 USING (rank, shard)),
owing AS (SELECT *, CAST(floor(target + 0.5e0) AS BIGINT) - CAST(sum(w0) OVER (PARTITION BY rank) AS BIGINT) AS owed,
   CAST(coalesce(sum(2 * cell - w0) OVER (PARTITION BY rank ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS room_before,
   CAST(coalesce(sum(w0) OVER (PARTITION BY rank ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before FROM seated),
given AS (SELECT rank, shard, source_size, target, greatest(cell, 1) AS cell, w0 + CASE WHEN owed > 0 THEN least(2 * cell - w0, greatest(0, owed - room_before)) ELSE -least(w0, greatest(0, -owed - words_before)) END AS words FROM owing),
stream AS (SELECT s.doc_id, s.size, g.source_size, g.target, g.words, g.cell,
   sum(s.size) OVER (PARTITION BY rank, shard ORDER BY substr(s.key, 9), s.size, s.doc_id ROWS UNBOUNDED PRECEDING) AS e
   FROM spread s JOIN given g USING (rank, shard))
SELECT doc_id, size, source_size, target, CAST((words // cell) * size + greatest(0, least(e, words % cell) - (e - size)) AS BIGINT) AS taken FROM stream
"""
