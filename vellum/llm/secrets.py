"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by SHA-256. The ledger holds a row for every pair
of blob and rule version that was scanned. Only pairs that it lacks are scanned, each distinct blob
once, and findings are joined back to all paths that hold the blob, a blob that very many paths
share in several tasks. Built of DataFrame functions alone.

Defined cases: a null text is the empty blob; a null path is kept as a path; equal texts are one
blob; an empty table gives an empty result; other columns are kept whatever their names. Positions
are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, spread_join


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of `pattern`; those whose `group` is shorter than `least` are dropped.

    `hint` is a regular expression that every text with a kept match matches.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hint=r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 24, hint=r"[0-9a-f]{24}"),
    # beyond the base kinds
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, hint="PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40, hint=r"gh[opsur]_[A-Za-z0-9]{36}"),
)
#: The kinds that base_sha256 covers.
BASE = ("assign", "access", "hex")
#: What a ledger holds: a row for every blob and rule version scanned, with the spans found.
SPANS = "array<struct<start:bigint,end:bigint>>"
LEDGER = f"blob string, rule string, spans {SPANS}"


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _spans(rule: Rule, text: Column) -> Column:
    """The spans of the rule's matches that stay: each begins after what lies before it and the gap to it."""
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("match"))
    body = (lambda m: m) if rule.group == 0 else (lambda m: F.regexp_extract(m, rule.pattern, rule.group))
    none = F.array().cast(SPANS)

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        stays = F.coalesce(F.length(body(x["match"])) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(stays, F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["out"]).alias("out"))

    every = F.aggregate(zipped, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step)["out"]
    return F.when(text.rlike(rule.hint or rule.pattern), every).otherwise(none)


def _pairs(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """`blobs` (blob, distinct) with todo: the rules that the ledger doesn't hold for it; those with none are left out."""
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").withColumn("todo", todo).filter(F.size("todo") > 0).drop("seen")


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New rows for the ledger: blob, rule, spans of every pair of a blob of `versions` (text) and a rule that it lacks.

    Clean pairs have no spans, so they count as scanned next time.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    todo = _pairs(versions.select(blob(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text")), ledger, rules)
    found = [F.when(F.array_contains("todo", rule.key), F.struct(F.lit(rule.key).alias("rule"), _spans(rule, F.col("text")).alias("spans"))) for rule in rules]
    return todo.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("of")).select("blob", "of.*")


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger, as a table, with what `versions` add to it; rows of other rule versions stay in it."""
    fresh = scan_unseen(versions, ledger, rules)
    return cut_lineage(fresh if ledger is None else ledger.select("blob", "rule", "spans").unionByName(fresh))


def by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans: all spans of a blob with findings of these rules, in order of start, then of the rules."""
    number = F.coalesce(*[F.when(F.col("rule") == r.key, i) for i, r in enumerate(rules)])
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("number") + 1)
    some = ledger.filter(F.size("spans") > 0).withColumn("number", number).filter("number is not null").dropDuplicates(["blob", "rule"])
    rows = some.withColumn("kind", kind).select("blob", F.explode("spans").alias("s"), "number", "kind")
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("s.start", "number", "kind", "s.end"))).alias("spans"))


def at_paths(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`versions` (text and any path columns) as path (a struct of the path columns), blob and spans, null without findings."""
    kept = [F.col(f"`{c}`") for c in versions.columns if c != "text"]
    paths = cut_lineage(versions.select(F.struct(F.lit(0).alias("_"), *kept).alias("path"), blob(F.col("text").cast("string")).alias("blob")))
    return spread_join(paths, by_blob(ledger, rules), ["blob"], "left")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (ascending by start; overlaps merge) replaced by a mark."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(
            F.concat(s["out"], F.when(x["start"] >= s["at"], F.concat(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
    )
    return F.when(spans.isNull() | (F.size(spans) == 0), text).otherwise(_finish(text, done))


def _finish(text: Column, done: Column) -> Column:
    return F.element_at(F.transform(F.array(done), lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.length(text)))), 1)


def editions(docs: DataFrame) -> DataFrame:
    """An earlier edition of every document, for want of a history: the first half of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), half.alias("text"))


def redact_all(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with the secrets in text blacked out, and n_chars, where there is one, brought up to date in those rows."""
    kept = ledger if ledger is not None else update_ledger(docs, None, rules)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), blob(F.col("text").cast("string")).alias("blob"))
    joined = spread_join(rows, by_blob(kept, rules), ["blob"], "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(redact(F.col("row.text"), F.col("spans")))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def secret_digest(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 (of the base kinds' spans) and spans (of all) of every document."""
    versions = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = at_paths(versions, update_ledger(versions, ledger, rules), rules)

    def of(*kinds: str) -> Column:
        return F.filter(F.coalesce("spans", F.array().cast("array<struct<start:bigint,number:int,kind:string,end:bigint>>")), lambda x: x["kind"].isin(*kinds))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("path.doc_id", *counts, F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(of(*(r.kind for r in rules))).alias("spans"))
