"""Secret scans with a ledger of blobs: every version of a content is scanned once for each version of a rule.

Contents are addressed by their SHA-256. A ledger (two Parquet tables below one folder) holds which pairs of blob
and rule version have been scanned and what was found; a run scans the pairs that it doesn't have, appends them, and joins
the findings of all blobs to all paths that have them. DataFrame functions only: a text is split at a rule's
matches, and running sums over the lengths of gaps and matches give the places.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import new_path

#: Pairs of blob and rule still to scan that are sent to all tasks; more are joined by a shuffle.
SMALL = 100_000


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, from the left and not overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# The patterns wanted. A run of 24 hex digits or more is a match of [0-9a-f]+ that long, since runs are maximal.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


def _matches(text: F.Column, rule: Rule) -> F.Column:
    """kind, version, and of each match the gap before it, its length and its group's length."""
    pattern = F.lit(rule.pattern)
    length = lambda x: F.length(x)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), length).alias("gap"), F.transform(whole, length).alias("size"), F.transform(part, length).alias("part")
    )
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), F.when(text.rlike(rule.pattern), found).alias("found"))


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, kind, version, begin, end (code points, end exclusive) of ``blobs``: blob, text, and todo, the kinds to scan or null for all."""
    each = blobs.select("blob", "todo", F.explode(F.array(*[_matches(F.col("text"), r) for r in rules])).alias("m"))
    wanted = F.col("todo").isNull() | F.array_contains(F.coalesce("todo", F.array(F.lit(""))), F.col("m.kind"))
    each = each.filter(F.col("m.found").isNotNull() & wanted)
    each = each.select("blob", "m.kind", "m.version", "m.least", F.posexplode("m.found").alias("at", "f"))
    each = each.filter(F.col("f.size").isNotNull())  # behind the last match there is a gap only
    upto = F.sum(F.col("f.gap") + F.col("f.size")).over(Window.partitionBy("blob", "kind").orderBy("at"))
    each = each.select("blob", "kind", "version", (upto - F.col("f.size")).alias("begin"), upto.alias("end"), "f.part", "least")
    return each.filter("part >= least").drop("part", "least")


class Ledger:
    """Scanned pairs and findings below a folder; runs append, and a run that broke off is done again."""

    def __init__(self, path: str):
        self.path = path

    def _table(self, spark, name: str, schema: str) -> DataFrame:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            return spark.read.schema(schema).parquet(f"{self.path}/{name}/*")
        return spark.createDataFrame([], schema)

    def scanned(self, spark) -> DataFrame:
        return self._table(spark, "scanned", "blob string, kind string, version int")

    def findings(self, spark) -> DataFrame:
        """Each once, also where a run wrote them but broke off before it noted what it scanned."""
        return self._table(spark, "findings", "blob string, kind string, version int, begin long, end long").distinct()

    def update(self, versions: DataFrame, text: str, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what of ``versions`` hasn't been scanned by these rule versions."""
        spark = versions.sparkSession
        contents = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        pairs = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]))
        todo = contents.select("blob").distinct().select("blob", pairs.alias("r")).select("blob", "r.kind", "r.version")
        run = uuid.uuid4().hex
        pending = f"{self.path}/pending/{run}"
        todo.join(self.scanned(spark), ["blob", "kind", "version"], "left_anti").write.parquet(pending)
        todo = spark.read.schema("blob string, kind string, version int").parquet(pending)
        kinds = todo.groupBy("blob").agg(F.collect_set("kind").alias("todo"))
        if todo.count() <= SMALL:
            texts = contents.join(F.broadcast(kinds), "blob").dropDuplicates(["blob"])
        else:  # copies meet before the join, so that a blob with many of them is one row
            texts = contents.dropDuplicates(["blob"]).join(kinds, "blob")
        found = findings(texts, rules)
        found.select("blob", "kind", F.col("version").cast("int"), F.col("begin").cast("long"), F.col("end").cast("long")).write.parquet(f"{self.path}/findings/{run}")
        todo.write.parquet(f"{self.path}/scanned/{run}")


def address(text: F.Column) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, paths: list[str], text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths`` columns of each row of ``versions``, its blob, and found: an array of (begin, order, kind, end), sorted.

    Null contents count as empty. Repeated rows and equal contents share what was found in their blob. Only findings of the
    given rule versions are returned. Without ``ledger`` a new one in the shared folder is used.
    """
    spark = versions.sparkSession
    book = Ledger(ledger or new_path(spark, "ledger"))
    book.update(versions, text, rules)
    order = F.coalesce(*[F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), i) for i, r in enumerate(rules)])
    found = book.findings(spark).withColumn("order", order).filter("order is not null")
    # A blob's findings are bounded by its text.
    by_blob = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("begin", "order", "kind", "end"))).alias("found"))
    rows = versions.select(*paths, address(F.col(text)).alias("blob"))
    empty = F.expr("cast(array() as array<struct<begin:bigint,order:int,kind:string,end:bigint>>)")
    return rows.join(by_blob, "blob", "left").withColumn("found", F.coalesce("found", empty))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ledger: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row: see ``scan``."""
    found = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", ledger)
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])))
    count = lambda i: F.size(F.filter("found", lambda s: s["order"] == i)).cast("long")
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
