"""Secret scan over an incremental blob ledger, with DataFrame operations only.

Every text (a version of a path) is addressed by its content.  A ledger keeps,
for every blob, the rule versions it was scanned with and what they found; only
(blob, rule version) pairs that are not in it are scanned, their rows are added
to it, and every result is the ledger's findings joined back to all paths that
hold a blob.  Copies are therefore scanned once, a second run over the same
texts scans nothing, and a changed rule rescans with that rule alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattflow.llm.common import attach, cut, remove_at_exit, shared_folder, whole_text


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0      # what the minimum length is of
    least: int = 1      # characters; shorter matches are consumed and dropped
    base: bool = True

    @property
    def version(self) -> str:
        """A short name that changes with the rule; every row of the ledger carries it."""
        return f"{self.kind}-{md5(f'{self.pattern}/{self.group}/{self.least}'.encode()).hexdigest()[:12]}"


# Fixed patterns, in the order that breaks ties of start.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 12),
    # a maximal run is consumed either way, so the length can stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
)
RULES = BASE_RULES + MORE_RULES
MASK = "[SECRET]"

# One row per blob and increment: the versions scanned, and their findings (code points, end exclusive).
LEDGER_SCHEMA = "blob string, versions array<string>, spans array<struct<version: string, start: int, end: int>>"


def _blob(text: Column) -> Column:
    return F.sha2(whole_text(text), 256)


def _matches(text: Column, number: int, rule: Rule) -> Column:
    """array<struct<kind_no, i, gap, size, ok>>: code points before and in each match, in order."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    measured = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    each = F.transform(F.arrays_zip(found.alias("whole"), F.slice(gaps, 1, F.size(found)).alias("gap"),
                                    measured.alias("part")), lambda m, i: F.struct(
        F.lit(number).alias("kind_no"), i.alias("i"), F.length(m["gap"]).alias("gap"),
        F.length(m["whole"]).alias("size"), (F.length(m["part"]) >= rule.least).alias("ok")))
    return F.when(text.rlike(rule.pattern), each)


def _checked(ledger: DataFrame) -> DataFrame:
    """A ledger without findings would hide every secret of the blobs in it."""
    missing = {"blob", "versions", "spans"} - set(ledger.columns)
    if missing:
        raise ValueError(f"the ledger has no {', '.join(sorted(missing))}: its findings belong beside its blobs")
    return ledger.select("blob", "versions", "spans")


def unseen(docs: DataFrame, text_col: str, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """(blob, text, todo): one row per blob with the rule versions it still needs.

    Copies are folded before the shuffle.  Against a ledger the contents are
    first looked up without their texts, and only unseen ones are moved.
    """
    texts = docs.select(_blob(F.col(text_col)).alias("blob"), whole_text(F.col(text_col)).alias("text"))
    wanted = F.array(*[F.lit(r.version) for r in rules])
    if ledger is None:
        return texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", wanted)
    done = _checked(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("done"))
    todo = (texts.groupBy("blob").agg(F.count(F.lit(1)).alias("paths"))
            .join(done, "blob", "left")
            .withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
            .filter(F.size("todo") > 0).select("blob", "paths", "todo"))
    moved = attach(texts, todo, "blob", "paths", ["text"]).filter(F.col("todo").isNotNull())
    return moved.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))


def scan(new: DataFrame, rules=RULES) -> DataFrame:
    """The ledger rows of unseen blobs, with empty spans where nothing was found."""
    hits = F.flatten(F.filter(F.array(*[
        F.when(F.array_contains("todo", r.version), _matches(F.col("text"), n, r))
        for n, r in enumerate(rules)]), lambda a: a.isNotNull()))
    rows = new.select("blob", F.col("todo").alias("versions"), F.inline_outer(hits))
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "kind_no").orderBy("i"))
    version = F.element_at(F.array(*[F.lit(r.version) for r in rules]), F.col("kind_no") + 1)
    span = F.struct(version.alias("version"), (F.col("end") - F.col("size")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return (rows.withColumn("end", so_far).groupBy("blob")
            .agg(F.first("versions").alias("versions"), F.collect_list(F.when(F.col("ok"), span)).alias("spans")))


def run_ledger(docs: DataFrame, text_col: str = "text", ledger: DataFrame | None = None,
               rules=RULES) -> tuple[DataFrame, DataFrame]:
    """One increment: (findings of the blobs of ``docs``, new ledger rows).

    The new rows are written to the shared folder; the findings come from them
    and from ``ledger``: (blob, paths, kind, kind_no, base, start, end), with
    ``paths`` the number of rows that hold the blob.  Findings of rule versions
    that are not in ``rules`` stay in the ledger and are left out here.
    """
    new = cut(scan(unseen(docs, text_col, ledger, rules), rules), "ledger")
    every = new if ledger is None else new.unionByName(_checked(ledger))
    held = docs.select(_blob(F.col(text_col)).alias("blob")).groupBy("blob").agg(F.count(F.lit(1)).alias("paths"))
    found = every.filter(F.size("spans") > 0).select("blob", F.inline("spans"))
    at = F.array_position(F.array(*[F.lit(r.version) for r in rules]), F.col("version")).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("kind_no") + 1)
    findings = (found.withColumn("kind_no", at - 1).filter("kind_no >= 0").join(held, "blob")
                .select("blob", "paths", pick([r.kind for r in rules]).alias("kind"), "kind_no",
                        pick([r.base for r in rules]).alias("base"), "start", "end"))
    return findings, new


def by_blob(findings: DataFrame) -> DataFrame:
    """One row per blob with findings: counts per base kind, joined span strings, merged spans."""
    span = F.struct("start", "kind_no", "end", "kind", "base")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    # spans that overlap become one to be masked
    before = F.max("end").over(Window.partitionBy("blob").orderBy("start", "end")
                               .rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.coalesce((F.col("start") >= before).cast("int"), F.lit(0))).over(
        Window.partitionBy("blob").orderBy("start", "end"))
    merged = (findings.withColumn("part", part).groupBy("blob", "part")
              .agg(F.max("paths").alias("paths"), F.collect_list(span).alias("spans"),
                   F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("cut")))
    out = merged.groupBy("blob").agg(
        F.max("paths").alias("paths"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.sort_array(F.collect_list("cut")).alias("cuts"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select("blob", "paths", count("assign").alias("n_assign"), count("access").alias("n_access"),
                      count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"),
                      text(F.col("spans")).alias("spans"), "cuts")


def _by_path(docs: DataFrame, id_col: str, text_col: str, findings: DataFrame) -> DataFrame:
    paths = docs.select(F.col(id_col).alias("doc_id"), _blob(F.col(text_col)).alias("blob"))
    joined = attach(paths, cut(by_blob(findings), "findings"), "blob", "paths", ["doc_id"])
    none = F.lit(0).cast("long")
    return joined.select("doc_id", *[F.coalesce(c, none).alias(c) for c in ("n_assign", "n_access", "n_hex")],
                         F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
                         F.coalesce("spans", F.lit("")).alias("spans"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None,
            rules=RULES) -> tuple[DataFrame, DataFrame]:
    """The findings of every path (doc_id, n_assign, n_access, n_hex, base_sha256, spans), and the
    rows to be added to the ledger.

    A null text is empty and holds nothing; a null id is kept; repeated rows are
    reported each; other columns are ignored; an empty table gives no rows.  A
    ledger without findings is refused.
    """
    findings, new = run_ledger(docs, text_col, ledger, rules)
    return _by_path(docs, id_col, text_col, findings), new


def scan_into(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``secrets`` by the ledger kept in ``folder`` (Parquet; made when absent), which gains the new rows."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(folder) if there else None
    found, new = secrets(docs, id_col, text_col, ledger, rules)
    new.write.mode("append").parquet(folder)
    return found


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan_into`` a ledger of its own, which goes when the application ends."""
    folder = shared_folder(docs.sparkSession, "wattflow-blobs")
    remove_at_exit(docs.sparkSession, folder)
    return scan_into(docs, folder, id_col, text_col)


def masked(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mask``; the other
    texts (null included), columns and rows stay as they are."""
    findings, _ = run_ledger(docs, text_col)
    spans = cut(by_blob(findings).select("blob", "paths", "cuts"), "findings")
    # whole rows as one struct, so no column of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       _blob(F.col(text_col)).alias("blob"))
    joined = attach(rows, spans, "blob", "paths", ["row"])
    text, cuts = F.col("row")[text_col], F.col("cuts")
    after = lambda i: F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0))
    kept = F.transform(cuts, lambda c, i: F.concat(
        F.substring(text, after(i) + 1, c["start"] - after(i)), F.lit(mask)))
    tail = F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text))
    new = F.when(cuts.isNull(), text).otherwise(F.concat(F.array_join(kept, ""), tail))
    return joined.select(F.col("row").withField(text_col, new).alias("row")).select("row.*")
