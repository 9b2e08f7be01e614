"""Secret scanning with an incremental blob ledger (operator 7), in DataFrame operations only.

Every version of every text is a blob named by its SHA-256.  A scan looks only at pairs of blob and rule version that
the ledger does not hold, and the findings join back to all rows (paths, documents) that hold the blob.  Spans are
found without positions from the regex engine: the text split by a pattern and the pattern's matches alternate, so
offsets are running sums of their lengths in code points.

A ledger is a table of (blob, kind, version, spans) in a folder of the shared store; a blob in which a rule finds nothing has a
row too.  record() scans what the ledger lacks and appends it, and findings come from the ledger alone, so a later version of the
texts costs a scan of its new blobs, and a rule of a new version a scan by that rule.

Defined cases: a null text is empty; a null id is kept; each row of the input gives one row; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
KEYS = "|".join(EITHER(w) for w in ("password", "passwd", "secret", "token")) + "|" + EITHER("api") + "_?" + EITHER("key")


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has at least `least` characters.  version: raised whenever the rule changes."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: In the order in which kinds are listed.  The runs of access and hex are maximal, so a least length in the pattern finds
#: the same matches as a filter after it.
RULES = (
    Rule("assign", f"({KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
SPAN = "array<struct<start: long, end: long, kind: string, rank: int>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    inner = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    triples = F.zip_with(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), inner, lambda a, i: F.struct(a["m"].alias("m"), a["g"].alias("g"), i.alias("i")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"))
        return F.struct(end.alias("at"), F.when(F.length(x["i"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    matched = F.filter(triples, lambda x: x["m"].isNotNull())  # the last gap has no match after it
    return F.when(text.rlike(rule.pattern), F.aggregate(matched, start, step)["out"]).otherwise(F.array().cast(SPAN))


def blobs(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Each different text once, with its name; copies meet in the partial aggregation."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def scan(found: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, kind, version, spans) for the blobs that the ledger lacks under a rule's version."""
    ranked = {r.kind: i for i, r in enumerate(rules)}
    entries = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(F.col("text"), r, ranked[r.kind]).alias("spans")) for r in rules])
    if ledger is not None:
        have = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", F.col("version").cast("string"))).alias("have"))
        known = F.coalesce(F.col("have"), F.array().cast("array<string>"))
        found = found.join(have, "blob", "left")
        entries = F.filter(F.array(*[F.when(~F.array_contains(known, f"{r.kind}:{r.version}"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(F.col("text"), r, ranked[r.kind]).alias("spans"))) for r in rules]), lambda x: x.isNotNull())
    return found.select("blob", F.explode(entries).alias("e")).select("blob", "e.*")


def opened(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at path, or none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return None
    return spark.read.schema(f"blob string, kind string, version int, spans {SPAN}").parquet(path)


def record(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """Scans the blobs and rule versions that the ledger at path lacks, appends what was found, and returns the ledger."""
    spark = docs.sparkSession
    scan(blobs(docs, text_col=text_col), rules, opened(spark, path)).write.mode("append").parquet(path)
    return opened(spark, path)


def recorded(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, blob and spans of every row of docs, as findings() gives them, from a ledger that holds all of its blobs."""
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    held = ledger.where(F.array_contains(current, F.concat_ws(":", "kind", F.col("version").cast("string"))) & (F.size("spans") > 0))
    return _joined(docs, held, id_col, text_col)


def findings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, blob and spans (by start, then kind as listed) of every row of docs; spans is empty where nothing is found."""
    new = scan(blobs(docs, text_col=text_col), rules, ledger)
    if ledger is not None:
        current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
        new = new.unionByName(ledger.where(F.array_contains(current, F.concat_ws(":", "kind", F.col("version").cast("string")))).select(*new.columns))
    return _joined(docs, new.where(F.size("spans") > 0), id_col, text_col)


def _joined(docs: DataFrame, held: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = held.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a row a rule
    order = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["rank"] - b["rank"])).cast("int"))
    rows = docs.select(docs[id_col].alias("_id"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("blob"))
    return rows.join(held, "blob", "left").select(F.col("_id").alias(id_col), "blob", F.coalesce(order, F.array().cast(SPAN)).alias("spans"))


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of findings()."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(id_col, *[count(r.kind).alias(f"n_{r.kind}") for r in rules], F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def redact(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced; overlapping spans are replaced together.  found: rows of findings(), once for each blob."""
    text, start = F.col("row")[text_col], F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], kept, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, step)
    whole = F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    by_blob = found.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("blob"))
    new = F.when(F.col("spans").isNull(), text).otherwise(whole)
    return rows.join(by_blob, "blob", "left").select(*[new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
