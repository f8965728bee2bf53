"""Evidence bundles as tables: sources, records, references and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUNDLE = """contract string, version string, collection_id string,
sources array<struct<id: string, publisher: string, document: string, revision: string, collection: string, independent_origin: string>>,
records array<struct<id: string, kind: string, type: string, subject: string, object: string, attributes: variant,
  times: map<string, struct<binding: struct<object: string, occurrence: string>, field: string, source_revision: string, clock: struct<id: string, reference: string, uncertainty_seconds: double>,
    timezone: string, precision: string, interval_role: string, value: string, start: string, `end`: string, start_inclusive: boolean, end_inclusive: boolean>>,
  evidence: array<struct<source_id: string, field: string>>>>"""


def read_evidence(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of all bundle files under a path."""
    files = spark.read.schema(BUNDLE).option("multiLine", True).json(path)
    records = files.select("collection_id", F.explode("records").alias("r"))
    return {
        "sources": files.select("collection_id", F.explode("sources").alias("s")).select("collection_id", "s.*"),
        "records": records.select("collection_id", *[F.col(f"r.{c}").alias(c) for c in ("id", "kind", "type", "subject", "object", "attributes")]),
        "evidence_refs": records.select("collection_id", F.col("r.id").alias("record_id"), F.posexplode("r.evidence").alias("place", "e")).select("collection_id", "record_id", "place", "e.source_id", "e.field"),
        "times": records.select("collection_id", F.col("r.id").alias("record_id"), F.explode("r.times").alias("time_name", "t")).select("collection_id", "record_id", "time_name", "t.*"),
    }


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """table, id, rule of every broken rule: repeated ids, dangling references, closed values."""
    s, r, e, t = (tables[k] for k in ("sources", "records", "evidence_refs", "times"))
    key = ["collection_id"]

    def repeated(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key, "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(name).alias("table"), "id", F.lit("repeated_id").alias("rule"))

    def dangling(df: DataFrame, name: str, column: str, owner: str, known: DataFrame) -> DataFrame:
        wanted = df.filter(F.col(column).isNotNull()).select(*key, F.col(owner).alias("owner"), F.col(column).alias("id"))
        return wanted.join(known.select(*key, "id").distinct(), [*key, "id"], "left_anti").select(F.lit(name).alias("table"), F.col("owner").alias("id"), F.lit(f"dangling_{column}").alias("rule"))

    rules = F.filter(F.array(
        F.when(~F.coalesce(F.col("kind").isin("entity", "assertion", "occurrence", "finding"), F.lit(False)), "kind"),
        F.when(F.coalesce(F.length(F.trim("type")), F.lit(0)) == 0, "blank_type"),
        F.when((F.col("kind") == "assertion") & F.col("subject").isNull(), "assertion_without_subject"),
    ), lambda x: x.isNotNull())
    closed = r.select(F.lit("records").alias("table"), "id", F.explode(rules).alias("rule"))
    bound = t.select(*key, "record_id", F.coalesce("binding.object", "binding.occurrence").alias("bound_to"))
    linked = e.join(s.select(*key, F.col("id").alias("source_id"), "revision"), [*key, "source_id"]).select(*key, "record_id", F.col("revision").alias("source_revision")).distinct()
    stray = t.filter("source_revision is not null").join(linked, [*key, "record_id", "source_revision"], "left_anti").select(F.lit("times").alias("table"), F.col("record_id").alias("id"), F.lit("revision_mismatch").alias("rule"))
    parts = [repeated(r, "records"), repeated(s, "sources"), closed, stray, dangling(r, "records", "subject", "id", r), dangling(r, "records", "object", "id", r), dangling(e, "evidence_refs", "source_id", "record_id", s), dangling(bound, "times", "bound_to", "record_id", r)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
