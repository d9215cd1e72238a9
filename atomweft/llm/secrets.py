"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its SHA-256, every rule by its kind and a hash of its
definition. The ledger has, for each blob, the rules it was scanned by and their findings; a
run scans a blob only by the rules that the ledger doesn't have for it, appends what it found,
and joins findings back to every path. A ledger may grow twice by the same pairs (two runs at
once): findings are made distinct on reading. Where there is a ledger, texts that it has
nothing to learn from are left out before any text is shuffled. Equal texts are one blob
before they are shuffled, so a text that a third of the rows share costs one scan.

Positions count code points, ends are exclusive. They come from the lengths of what stands
between the matches and of the matches themselves. All steps are DataFrame functions. No
rule's pattern can begin within a run that it reads over, so time is linear in a text.

Null text counts as empty, which has no findings. Repeated rows each get their findings; an
empty table gives no row; further columns are not read (redact keeps them).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import joined_anew


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 1  #: code points of `group`
    group: int = 0

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha1(f'{self.pattern} {self.least} {self.group}'.encode()).hexdigest()[:12]}"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])

BASE = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),  # what [0-9a-f]+ finds, and is long enough
)
FURTHER = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + FURTHER
LEDGER = "blob string, rules array<string>, findings array<struct<start:long,rule:string,stop:long>>"
FOUND = "array<struct<start:long,kind:int,stop:long>>"
CHUNK = 512


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _lengths(n: int, rule: Rule) -> Column:
    """The lengths between the matches, of the matches and of what must be long enough; null without a match."""
    t, p = F.col("text"), F.lit(rule.pattern)
    size = lambda a: F.transform(a, lambda x: F.char_length(x).cast("long"))
    found = F.regexp_extract_all(t, p, F.lit(0))
    held = F.regexp_extract_all(t, p, F.lit(rule.group)) if rule.group else found
    return F.when(F.array_contains("todo", rule.version) & t.rlike(rule.pattern), F.struct(F.lit(n).alias("kind"), F.lit(rule.least).cast("long").alias("least"), size(F.split(t, rule.pattern, -1)).alias("gaps"), size(found).alias("found"), size(held).alias("held")))


def find(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, todo and the raw matches of the rules named in todo, for rows (blob, text, todo)."""
    return blobs.select("blob", "todo", F.filter(F.array(*[_lengths(n, r) for n, r in enumerate(rules)]), lambda x: x.isNotNull()).alias("raw"))


def located(raw: DataFrame) -> DataFrame:
    """blob, findings: sorted structs (start, kind, stop); a window per blob and rule adds up the lengths."""
    one = raw.select("blob", F.explode("raw").alias("r")).select("blob", "r.kind", "r.least", F.posexplode(F.arrays_zip("r.gaps", "r.found", "r.held")).alias("nth", "m"))
    one = one.filter(F.col("m.found").isNotNull())
    run = Window.partitionBy("blob", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("stop", F.sum(F.col("m.gaps") + F.col("m.found")).over(run)).filter(F.col("m.held") >= F.col("least"))
    one = one.select("blob", F.struct((F.col("stop") - F.col("m.found")).alias("start"), "kind", "stop").alias("f"))
    return one.groupBy("blob").agg(F.sort_array(F.collect_list("f")).alias("findings"))


def ledger_of(spark, ledger_dir: str) -> DataFrame | None:
    """The ledger's rows, or None where nothing was ever scanned."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger_dir}/ledger")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(f"{ledger_dir}/ledger")


def unseen(docs: DataFrame, ledger: DataFrame | None, rules=RULES, text: str = "text") -> DataFrame:
    """blob, text and todo (versions of rules) of what the ledger lacks."""
    every = F.array(*[F.lit(r.version) for r in rules])
    rows = docs.select(blob_id(F.col(text)).alias("blob"), common.text_or_empty(text).alias("text"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        new = rows.select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)
        rows = joined_anew(rows, new, "blob", anew=F.reverse)
    else:
        rows = rows.withColumn("todo", every)
    return rows.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))


def update(docs: DataFrame, ledger_dir: str, rules=RULES, text: str = "text") -> int:
    """Bring the ledger up to date with docs; returns the number of blobs that were scanned."""
    spark = docs.sparkSession
    scratch = common.shared_dir(spark, "scan")
    raw = common.materialise(find(unseen(docs, ledger_of(spark, ledger_dir), rules, text), rules), scratch)
    names = F.array(*[F.lit(r.version) for r in rules])
    named = F.transform("findings", lambda f: F.struct(f["start"].alias("start"), F.element_at(names, f["kind"] + 1).alias("rule"), f["stop"].alias("stop")))
    rows = raw.select("blob", F.col("todo").alias("rules")).join(located(raw), "blob", "left")
    rows = rows.withColumn("findings", F.coalesce(named, F.array().cast("array<struct<start:long,rule:string,stop:long>>")))
    n = raw.count()
    if n or ledger_of(spark, ledger_dir) is None:
        rows.select("blob", "rules", "findings").write.mode("append").parquet(f"{ledger_dir}/ledger")
    common.remove(spark, scratch)
    return n


def findings(spark, ledger_dir: str, rules=RULES) -> DataFrame:
    """blob, findings (sorted structs start, kind, stop) of all blobs of the ledger that have any by these rules."""
    names = F.array(*[F.lit(r.version) for r in rules])
    rows = ledger_of(spark, ledger_dir).filter(F.size("findings") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("f"))
    held = F.filter("f", lambda f: F.array_contains(names, f["rule"]))
    kinds = F.transform(held, lambda f: F.struct(f["start"].alias("start"), (F.array_position(names, f["rule"]) - 1).cast("int").alias("kind"), f["stop"].alias("stop")))
    return rows.select("blob", F.sort_array(kinds).alias("findings")).filter(F.size("findings") > 0)


def scan(docs: DataFrame, ledger_dir: str, rules=RULES, text: str = "text") -> DataFrame:
    """docs' columns with `findings`, through a ledger that is brought up to date first."""
    update(docs, ledger_dir, rules, text)
    rows = docs.withColumn("__blob", blob_id(F.col(text)))
    found = findings(docs.sparkSession, ledger_dir, rules).withColumnsRenamed({"blob": "__blob", "findings": "__found"})
    rows = joined_anew(rows, found, "__blob", "left", F.reverse)
    return rows.select(*docs.columns, F.coalesce("__found", F.array().cast(FOUND)).alias("findings"))


def joined(findings: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", F.element_at(names, f["kind"] + 1), f["start"], f["stop"])), ",")


def digest(found: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the counts and digests of its base findings, and all spans."""
    base = F.filter("findings", lambda f: f["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{BASE[k].kind}")
    return found.select("doc_id", *map(count, range(len(BASE))), F.sha2(joined(base, rules), 256).alias("base_sha256"), joined(F.col("findings"), rules).alias("spans"))


def _piece(chunks: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of a text cut into chunks; reads only the chunks it touches."""
    first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
    at = (a % CHUNK + 1).cast("int")
    within = F.substring(F.get(chunks, first), at, (b - a).cast("int"))
    between = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substring(F.get(chunks, first), at, F.lit(CHUNK)), between, F.substring(F.get(chunks, last), F.lit(1), ((b - 1) % CHUNK + 1).cast("int")))
    return F.when(b <= a, F.lit("")).when(first == last, within).otherwise(across)


def redact(docs: DataFrame, ledger_dir: str, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every finding replaced by `mark`; overlapping findings are replaced once."""
    update(docs, ledger_dir)
    one = findings(docs.sparkSession, ledger_dir).select("blob", F.explode("findings").alias("f")).select("blob", "f.*")
    before = Window.partitionBy("blob").orderBy("start", "kind", "stop").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("reached", F.coalesce(F.max("stop").over(before), F.lit(0)))
    gap = F.when(F.col("start") >= F.col("reached"), F.struct(F.col("reached").alias("a"), F.col("start").alias("b")))
    cuts = one.groupBy(F.col("blob").alias("__blob")).agg(F.sort_array(F.collect_list(gap)).alias("__gaps"), F.max("stop").alias("__tail"))
    rows = joined_anew(docs.withColumn("__blob", blob_id(F.col("text"))), cuts, "__blob", "left", F.reverse)
    rows = rows.withColumn("__chunks", F.when(F.col("__gaps").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    kept = F.transform("__gaps", lambda g: F.concat(_piece(F.col("__chunks"), g["a"], g["b"]), F.lit(mark)))
    done = F.concat(F.array_join(kept, ""), _piece(F.col("__chunks"), F.col("__tail"), F.char_length("text").cast("long")))
    out = rows.withColumn("text", F.when(F.col("__gaps").isNotNull(), done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def _sql(rules=RULES) -> str:
    """The query in DuckDB's SQL, whose patterns have no lookbehind: what one asks for is read, in a first group, and not counted."""

    def spans(n: int, r: Rule) -> str:
        ahead = "(?<![A-Za-z0-9_-])"
        pattern = r.pattern.replace("}+", "}").replace("'", "''")
        lead = pattern.startswith(ahead)
        pattern = "(^|[^A-Za-z0-9_-])" + pattern.removeprefix(ahead) if lead else pattern
        m, g = f"regexp_extract_all(t, '{pattern}', 0)", f"string_split_regex(t, '{pattern}')"
        held = f"regexp_extract_all(t, '{pattern}', {r.group})" if r.group else m
        pre = f"length(regexp_extract_all(t, '{pattern}', 1)[i])" if lead else "0"
        total = lambda x: f"coalesce(list_sum([length(x) for x in {x}]), 0)"
        begin = f"{total(g + '[1:i]')} + {total(m + '[1:i - 1]')}"
        item = f"{{'s': CAST({begin} + {pre} AS BIGINT), 'k': {n}, 'e': CAST({begin} + length({m}[i]) AS BIGINT)}}"
        return f"[{item} for i in range(1, len({m}) + 1) if length({held}[i]) - {pre} >= {r.least}]"

    names = ", ".join(f"'{r.kind}'" for r in rules)
    line = lambda x: f"coalesce(array_to_string([[{names}][y.k + 1] || ':' || y.s || ':' || y.e for y in {x}], ','), '')"
    base = f"[y for y in f if y.k < {len(BASE)}]"
    counts = ", ".join(f"CAST(len([y for y in f if y.k = {n}]) AS BIGINT) AS n_{r.kind}" for n, r in enumerate(BASE))
    every = ", ".join(spans(n, r) for n, r in enumerate(rules))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (SELECT doc_id, list_sort(flatten([{every}])) AS f FROM d)
SELECT doc_id, {counts}, sha256({line(base)}) AS base_sha256, {line("f")} AS spans FROM found"""


SQL = _sql()
