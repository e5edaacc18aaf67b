"""Research tables: findings, descriptive statistics, anchor references, claim nodes.

Each is a keyed table kept as main and delta: writes go to the delta, reads take the delta's rows first, and a
compaction folds the delta into the main table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from stemma.functions import checks, text, vocab
from stemma.functions.schemas import schema
from stemma.operators import upsert
from stemma.sources import tables


def _schema(strings: str, **others: str) -> StructType:
    return schema(", ".join(f"{n} {others.get(n, 'string')}" for n in strings.split()))


@dataclass
class Table:
    """One kind of research table."""

    name: str
    schema: StructType
    keys: list[str]
    required: list[str]
    searched: list[str]
    vocabularies: dict[str, dict[str, str]] = field(default_factory=dict)
    unique: bool = False

    def template(self, spark: SparkSession) -> DataFrame:
        """One row of nulls."""
        return spark.createDataFrame([tuple(None for _ in self.schema)], self.schema)

    def normalize(self, rows: DataFrame) -> DataFrame:
        """Exactly the table's columns, vocabularies applied; legacy names and absent ranks and ids are filled in."""
        for old, new in (("reference", "anchor_title"), ("role", "anchor_role"), ("sentence", "claim_sentence"), ("relation", "modifier_text"), ("reuse_context", "citation_use")):
            if old in rows.columns and new in self.schema.names and old not in self.schema.names:
                value = F.col(old) if new not in rows.columns else F.coalesce(F.when(F.trim(new) != "", F.col(new)), F.col(old))
                rows = rows.withColumn(new, value)
        seq = F.row_number().over(Window.partitionBy("ref_id").orderBy(*[c for c in ("seq",) if c in rows.columns] or ["ref_id"]))
        if "anchor_rank" in self.keys:
            rank = F.col("anchor_rank").cast("int") if "anchor_rank" in rows.columns else F.lit(None).cast("int")
            rows = rows.withColumn("anchor_rank", F.when(rank >= 1, rank).otherwise(seq))
        if "node_id" in self.keys:
            node = F.col("node_id") if "node_id" in rows.columns else F.lit(None).cast("string")
            rows = rows.withColumn("node_id", F.when(F.trim(node) != "", node).otherwise(F.concat(F.lit("node_"), seq)))
        out = checks.align(rows, self.schema)
        for name, words in self.vocabularies.items():
            out = out.withColumn(name, vocab.normalize(F.col(name), words))
        return merge_nodes(out) if "node_id" in self.keys else out

    def problems(self, rows: DataFrame) -> DataFrame:
        """(ref_id, problem) of rows that break the table's rules."""
        tests: list[Column] = []
        for name in self.required:
            blank = F.coalesce(F.trim(F.col(name).cast("string")) == "", F.lit(True))
            tests.append(F.when(blank, F.lit(f"{name} is blank")))
        if "anchor_rank" in self.keys:
            tests.append(F.when(F.coalesce(F.col("anchor_rank") < 1, F.lit(True)), F.lit("anchor_rank is below 1")))
        for name, words in self.vocabularies.items():
            tests.append(F.when(~vocab.known(F.col(name), words), F.lit(f"{name} is outside the vocabulary")))
        out = rows.select("ref_id", F.explode(F.array_compact(F.array(*tests))).alias("problem"))
        if self.unique:
            twice = rows.groupBy(*self.keys).count().where("count > 1")
            out = out.unionByName(twice.select("ref_id", F.lit("key is not unique").alias("problem")))
        return out

    def validate(self, rows: DataFrame) -> None:
        checks.require_columns(rows, *self.required)
        checks.require_none(self.problems(rows), self.name)

    def write(self, rows: DataFrame, root: str, seq: str | None = None) -> None:
        """Validate, normalise and upsert into the delta; a key that comes twice is an error, or the first by ``seq`` counts."""
        given = checks.align(rows, StructType([f for f in self.schema if f.name in rows.columns]))
        for name, words in self.vocabularies.items():
            if name in given.columns:
                vocab.require(given, name, words)
        if seq is not None:
            rows = upsert.keep_first(rows, [k for k in self.keys if k in rows.columns], seq)
        new = self.normalize(rows)
        self.validate(new)
        spark = rows.sparkSession
        tables.overwrite(upsert.upsert(tables.load(spark, f"{root}/{self.name}/delta", self.schema), new, self.keys), f"{root}/{self.name}/delta")

    def read(self, spark: SparkSession, root: str, ref_ids: list[str] | None = None) -> DataFrame:
        main, delta = (tables.load(spark, f"{root}/{self.name}/{part}", self.schema) for part in ("main", "delta"))
        if ref_ids is not None:
            main, delta = (df.where(F.col("ref_id").isin(ref_ids)) for df in (main, delta))
        return upsert.merge_on_read(main, delta, self.keys)

    def find(self, rows: DataFrame, query: str | None = None, **members) -> DataFrame:
        """Rows by allowed values of columns and a literal substring over the searched columns."""
        for name, values in members.items():
            if values is not None:
                values = list(values) if isinstance(values, list | tuple | set) else [values]
                if name in self.vocabularies:
                    known = vocab.aliases(self.vocabularies[name])
                    values = [known.get(str(v).strip().lower().replace(" ", "_").replace("-", "_"), vocab.UNKNOWN) for v in values]
                rows = rows.where(F.col(name).isin(values))
        return rows.where(text.contains_ci(query, F.concat_ws(" ", *self.searched))) if query else rows

    def compact(self, spark: SparkSession, root: str) -> None:
        tables.overwrite(self.read(spark, root), f"{root}/{self.name}/main")
        tables.remove(spark, f"{root}/{self.name}/delta")

    rebuild = compact


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are equal but for tags and times as one: all tags, first created, last updated."""
    same = [c for c in nodes.columns if c not in ("tags", "created_at", "updated_at")]
    parts = F.array_distinct(F.filter(F.flatten(F.collect_list(F.split("tags", r"\s*;\s*"))), lambda x: F.trim(x) != ""))
    out = nodes.groupBy(*same).agg(
        F.when(F.size(parts) > 0, F.array_join(F.array_sort(parts), "; ")).alias("tags"),
        F.min(F.when(F.trim("created_at") != "", F.col("created_at"))).alias("created_at"),
        F.max(F.when(F.trim("updated_at") != "", F.col("updated_at"))).alias("updated_at"),
    )
    return out.select(*nodes.columns)


_N = dict.fromkeys("effect_size standard_error t_stat p_value confidence_interval_low confidence_interval_high n mean sd min p25 median p75 max".split(), "double")

FINDINGS = Table(
    "standardized_findings",
    _schema(
        "ref_id finding_id paper_type research_question hypothesis outcome_variable treatment_variable moderator_variable method sample sample_period "
        "sample_region effect_direction effect_size standard_error t_stat p_value confidence_interval_low confidence_interval_high unit "
        "model_specification finding_text evidence_strength extraction_method extracted_at notes", **_N,
    ),
    ["ref_id", "finding_id"],
    ["ref_id", "finding_id"],
    "research_question hypothesis outcome_variable treatment_variable moderator_variable method sample sample_period sample_region effect_direction "
    "model_specification finding_text evidence_strength notes".split(),
    {"paper_type": vocab.PAPER_TYPES},
)
STATISTICS = Table(
    "descriptive_stats",
    _schema("ref_id table_id variable label n mean sd min p25 median p75 max unit sample sample_period source_table extraction_method extracted_at notes", **_N),
    ["ref_id", "table_id", "variable"],
    ["ref_id", "table_id", "variable"],
    "variable label unit sample sample_period source_table notes".split(),
)
ANCHORS = Table(
    "anchor_references",
    _schema(
        "ref_id anchor_rank citation_key anchor_title anchor_authors anchor_year anchor_ref_id anchor_role reason relationship_to_current_paper confidence "
        "created_at updated_at", anchor_rank="int", anchor_year="int",
    ),
    ["ref_id", "anchor_rank"],
    ["ref_id"],
    "citation_key anchor_title anchor_authors anchor_year anchor_ref_id anchor_role reason relationship_to_current_paper confidence ref_id".split(),
    {"anchor_role": vocab.ANCHOR_ROLES, "relationship_to_current_paper": vocab.RELATIONSHIPS, "confidence": vocab.CONFIDENCE},
    unique=True,
)
NODES = Table(
    "citation_logic_nodes",
    _schema(
        "ref_id node_id claim_sentence logic_type subject_text object_text modifier_text evidence_role confidence page_or_section quote_support "
        "citation_use tags created_at updated_at"
    ),
    ["ref_id", "node_id"],
    ["ref_id", "node_id", "claim_sentence"],
    "node_id claim_sentence logic_type subject_text object_text modifier_text evidence_role confidence page_or_section quote_support citation_use tags ref_id".split(),
    {"logic_type": vocab.LOGIC_TYPES, "evidence_role": vocab.EVIDENCE_ROLES, "confidence": vocab.CONFIDENCE},
    unique=True,
)
TABLES = {t.name: t for t in (FINDINGS, STATISTICS, ANCHORS, NODES)}
