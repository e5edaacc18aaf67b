"""Digests of records: revisions, latest view, flattening, validation, prompts."""

from __future__ import annotations

import copy
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions import checks, text, vocab
from stemma.functions.schemas import schema
from stemma.sources import tables

_LISTS = "research_questions paper_structure methods key_findings limitations contribution_type keywords"
_TEXTS = (
    "extraction_mode prompt_version model_hint paper_type summary motivation identification_strategy theoretical_mechanism empirical_setting "
    "descriptive_statistics_summary standardized_findings_summary evidence_strength notes generated_at updated_at"
)
_VARIABLES = "dependent_variables independent_variables control_variables mechanism_variables"
VERSIONS = ("v1", "v2", "v3", "v4", "v5")
SCHEMA = schema(
    "ref_id string, schema_version string, digest_revision int, derived_from_revision int, "
    + ", ".join(f"{n} string" for n in _TEXTS.split())
    + ", "
    + ", ".join(f"{n} array<string>" for n in f"{_LISTS} likely_reader_misconceptions business_relevance_pathway".split())
    + ", research_data struct<data_sources:array<string>,sample_period:string,sample_region:string,unit_of_observation:string,sample_size:string,sample_size_note:string>"
    + f", main_variables struct<{','.join(f'{n}:array<string>' for n in _VARIABLES.split())}>"
    + ", anchor_references array<struct<anchor_rank:int,anchor_ref_id:string,anchor_title:string,anchor_role:string,relationship_to_current_paper:string,confidence:string,reason:string>>"
    + ", citation_logic_nodes array<struct<node_id:string,claim_sentence:string,logic_type:string,evidence_role:string,confidence:string,tags:string>>"
    + ", ranked_contributions array<struct<rank:int,contribution:string>>, tables array<struct<table_id:string,title:string>>"
    + ", research_target_github_links array<struct<url:string,label:string>>"
    + ", evidence_shape struct<evidence_mode:string,evidence_basis:array<string>,inference_type:string,strength_level:string,limitations:array<string>>"
    + ", formulas array<struct<formula_id:string,latex:string>>"
)


def template(ref_id: str, version: str = "v5") -> dict:
    """A digest with nothing filled in."""
    if version not in VERSIONS:
        raise ValueError(f"unknown schema version {version}")
    if version == "v1":
        lists = "research_questions methods key_findings limitations keywords".split()
        return {"ref_id": ref_id, "summary": None, "motivation": None, "sample": {"description": None, "size": None, "period": None}, "notes": None, **{n: [] for n in lists}}
    out: dict = {"schema_version": version, "ref_id": ref_id, "digest_revision": 1, "derived_from_revision": None}
    out |= {n: None for n in _TEXTS.split()} | {n: [] for n in _LISTS.split()}
    out |= {"extraction_mode": "unknown", "paper_type": "unknown"}
    out["research_data"] = {"data_sources": [], **dict.fromkeys("sample_period sample_region unit_of_observation sample_size sample_size_note".split())}
    out["main_variables"] = {n: [] for n in _VARIABLES.split()}
    more = {
        "v3": ("anchor_references", "citation_logic_nodes"),
        "v4": ("ranked_contributions", "likely_reader_misconceptions", "business_relevance_pathway", "tables", "research_target_github_links"),
        "v5": ("formulas",),
    }
    for since, names in more.items():
        if version >= since:
            out |= {n: [] for n in names}
    if version >= "v4":
        out["evidence_shape"] = {"evidence_mode": "unknown", "evidence_basis": [], "inference_type": "unknown", "strength_level": "unknown", "limitations": []}
    return copy.deepcopy(out)


def parse(df: DataFrame, json: str = "json") -> DataFrame:
    """Digest rows of JSON documents, one a row; the version is inferred where none is given."""
    got = df.select(F.from_json(json, SCHEMA).alias("d")).select("d.*")
    inferred = (
        F.when(F.col("formulas").isNotNull(), "v5").when(F.col("evidence_shape").isNotNull(), "v4").when(F.col("anchor_references").isNotNull(), "v3")
        .when(F.col("paper_type").isNotNull() | F.col("digest_revision").isNotNull(), "v2").otherwise("v1")
    )
    got = got.withColumn("schema_version", F.coalesce("schema_version", inferred))
    return normalize(got)


def sample_size(c: Column, note: Column) -> Column:
    """Struct (sample_size double, sample_size_note): a text that isn't a number goes to the note."""
    clean = F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    words = F.when(clean.isNull() & (F.trim(c) != ""), F.trim(c))
    return F.struct(clean.alias("sample_size"), F.coalesce(F.when(F.trim(note) != "", note), words).alias("sample_size_note"))


def normalize(digests: DataFrame) -> DataFrame:
    """Vocabularies applied, absent lists empty, absent modes unknown."""
    out = digests
    for f in digests.schema:
        if f.dataType.simpleString() == "array<string>":
            out = out.withColumn(f.name, F.coalesce(f.name, F.array().cast("array<string>")))
    out = out.withColumn("paper_type", vocab.normalize(F.col("paper_type"), vocab.PAPER_TYPES))
    out = out.withColumn("extraction_mode", F.coalesce(F.when(F.trim("extraction_mode") != "", F.col("extraction_mode")), F.lit("unknown")))
    if "anchor_references" in out.columns:
        anchors = F.transform(
            "anchor_references",
            lambda a: a.withField("anchor_role", vocab.normalize(a["anchor_role"], vocab.ANCHOR_ROLES))
            .withField("relationship_to_current_paper", vocab.normalize(a["relationship_to_current_paper"], vocab.RELATIONSHIPS))
            .withField("confidence", vocab.normalize(a["confidence"], vocab.CONFIDENCE)),
        )
        out = out.withColumn("anchor_references", anchors)
    return out


def append(history: DataFrame, new: DataFrame) -> DataFrame:
    """History with one more revision of each new digest: the number after the latest of its id."""
    last = history.groupBy("ref_id").agg(F.max("digest_revision").alias("__last"))
    rows = new.join(last, "ref_id", "left").withColumn("derived_from_revision", F.col("__last").cast("int"))
    rows = rows.withColumn("digest_revision", (F.coalesce("__last", F.lit(0)) + 1).cast("int")).drop("__last")
    return history.unionByName(rows, allowMissingColumns=True)


def latest(history: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc("digest_revision"), F.desc("updated_at")))
    return history.withColumn("__n", first).where("__n = 1").drop("__n")


def revisions(history: DataFrame, ref_id: str) -> DataFrame:
    """Revisions of one id, newest first, the first marked as current."""
    rows = history.where(F.col("ref_id") == ref_id).select("digest_revision", "updated_at")
    top = rows.agg(F.max("digest_revision").alias("__top"))
    return rows.crossJoin(top).withColumn("current", F.col("digest_revision") == F.col("__top")).drop("__top").orderBy(F.desc("digest_revision"))


def flatten(digests: DataFrame) -> DataFrame:
    """One flat column a field: lists joined by newlines, structs by their parts."""
    out = []
    for f in digests.schema:
        kind = f.dataType.simpleString()
        if kind == "array<string>":
            out.append(F.array_join(f.name, "\n").alias(f.name))
        elif kind.startswith("array"):
            out.append(F.size(f.name).alias(f"n_{f.name}"))
        elif kind.startswith("struct"):
            for part in f.dataType:
                c = F.col(f"{f.name}.{part.name}")
                out.append((F.array_join(c, "\n") if part.dataType.simpleString().startswith("array") else c).alias(f"{f.name}_{part.name}"))
        else:
            out.append(F.col(f.name))
    return digests.select(*out)


def find(digests: DataFrame, query: str) -> DataFrame:
    """Digests whose text has ``query``, any case."""
    return digests.where(text.contains_ci(query, F.to_json(F.struct(*digests.columns))))


def problems(digests: DataFrame) -> DataFrame:
    """(ref_id, problem) of all that a valid digest may not have."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    since = lambda v: F.col("schema_version") >= v
    some = lambda name, bad: F.exists(name, bad)
    shape = [
        (since("v4") & F.col(f"evidence_shape.{axis}").isNotNull() & ~F.col(f"evidence_shape.{axis}").isin(levels), f"evidence_shape.{axis}")
        for axis, levels in vocab.EVIDENCE_SHAPE.items()
    ]
    rules = [
        (blank(F.col("ref_id")), "ref_id is blank"),
        (~F.col("schema_version").isin(*VERSIONS), "schema_version is unknown"),
        (since("v2") & F.coalesce(F.col("digest_revision") < 1, F.lit(True)), "digest_revision is below 1"),
        (since("v2") & (F.col("derived_from_revision") < 1), "derived_from_revision is below 1"),
        (since("v2") & blank(F.col("extraction_mode")), "extraction_mode is blank"),
        (since("v2") & ~vocab.known(F.col("paper_type"), vocab.PAPER_TYPES), "paper_type is outside the vocabulary"),
        (since("v2") & F.col("research_data").isNull(), "research_data is missing"),
        (since("v2") & F.col("main_variables").isNull(), "main_variables is missing"),
        (some("anchor_references", lambda a: F.coalesce(a["anchor_rank"] < 1, F.lit(True))), "an anchor has no rank"),
        (F.size(F.array_distinct(F.transform("anchor_references", lambda a: a["anchor_rank"]))) < F.size("anchor_references"), "anchor ranks repeat"),
        (some("citation_logic_nodes", lambda n: blank(n["claim_sentence"])), "a claim node has no sentence"),
        (since("v4") & some("ranked_contributions", lambda c: blank(c["contribution"]) | F.coalesce(c["rank"] < 1, F.lit(True))), "a contribution has no rank or text"),
        (since("v4") & some("research_target_github_links", lambda x: ~F.coalesce(x["url"].rlike(r"^https?://(www\.)?github\.com/"), F.lit(False))), "a link is not of the code host"),
        (since("v4") & some("tables", lambda x: blank(x["table_id"])), "a table has no id"),
        (since("v5") & some("formulas", lambda x: blank(x["latex"])), "a formula is blank"),
        *shape,
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))
    return digests.select("ref_id", F.explode(found).alias("problem"))


def validate(digests: DataFrame) -> None:
    checks.require_none(problems(digests), "digest")


def upgrade(digests: DataFrame) -> DataFrame:
    """Digests of the first version as the second; later ones stay as they are."""
    old = F.col("schema_version") == "v1"
    return digests.withColumns(
        {"digest_revision": F.when(old, F.coalesce("digest_revision", F.lit(1))).otherwise(F.col("digest_revision")), "schema_version": F.when(old, "v2").otherwise(F.col("schema_version"))}
    )


def details(digests: DataFrame) -> DataFrame:
    """(ref_id, summary, theoretical_mechanism, github_urls) as a graph's nodes show them."""
    urls = F.array_join(F.array_distinct(F.transform("research_target_github_links", lambda x: x["url"])), "\n")
    return digests.select("ref_id", "summary", "theoretical_mechanism", urls.alias("github_urls"))


def prompt(fragments: dict[str, str], values: dict[str, str], mode: str, has_digest: bool) -> str:
    """A prompt of fragments with ``{{name}}`` tokens replaced literally, in one pass.

    Creating is refused where a digest exists, revising where none does.
    """
    if mode == "create" and has_digest:
        raise ValueError("a digest exists; revise it")
    if mode == "revise" and not has_digest:
        raise ValueError("there is no digest to revise")
    if mode not in ("create", "revise"):
        raise ValueError(f"unknown mode {mode}")
    order = [n for n in ("intro", mode, "metadata", "source", "schema", "return_format") if n in fragments]
    whole = "\n\n".join(fragments[n] for n in order)
    out = re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: values.get(m[1], m[0]), whole)
    left = sorted(set(re.findall(r"\{\{\s*(\w+)\s*\}\}", whole)) - set(values))
    if left:
        raise ValueError(f"no value for {', '.join(left)}")
    return out


class Store:
    """Digests on disk: all revisions; the latest of each id counts."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def history(self) -> DataFrame:
        return tables.load(self.spark, f"{self.root}/history", SCHEMA)

    def write(self, digests: DataFrame, keep_history: bool = True, bump_revision: bool = True) -> None:
        """Normalise, number, validate and append digests, one an id.

        The revision is that after the latest; where the schema version differs from the latest's, that counts as revision 1. Without ``bump_revision``
        a digest keeps the number it has and replaces the revision of that number; without ``keep_history`` older revisions go.
        """
        checks.require_unique(digests.select("ref_id"), "ref_id")
        old = self.history()
        new = normalize(checks.align(digests, SCHEMA))
        if bump_revision:
            last = latest(old).select(F.col("ref_id").alias("__id"), F.col("schema_version").alias("__v"), F.col("digest_revision").alias("__r"))
            joined = new.join(last, F.col("ref_id") == F.col("__id"), "left")
            before = F.when(F.col("__id").isNotNull(), F.when(F.col("__v").eqNullSafe(F.col("schema_version")), F.coalesce("__r", F.lit(1))).otherwise(F.lit(1)))
            joined = joined.withColumn("derived_from_revision", before.cast("int"))
            top = old.groupBy(F.col("ref_id").alias("__t")).agg(F.max("digest_revision").alias("__top"))
            joined = joined.join(top, F.col("ref_id") == F.col("__t"), "left")
            new = joined.withColumn("digest_revision", (F.coalesce(before, F.lit(0)) + 1).cast("int")).drop("__id", "__v", "__r", "__t", "__top")
        new = tables.once(new, "digests")
        validate(new)
        named = new.select(F.col("ref_id").alias("__id"), F.col("digest_revision").alias("__r"))
        same = F.col("ref_id") == F.col("__id")
        if keep_history:  # a revision of the same number is of an older schema, or is written anew
            same = same & (F.col("digest_revision") >= F.col("__r"))
        tables.overwrite(old.join(named, same, "left_anti").unionByName(new), f"{self.root}/history")

    def read(self, ref_ids: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The latest digest of each id, upgraded to the newest form."""
        rows = self.history()
        if ref_ids is not None:
            rows = rows.where(F.col("ref_id").isin(ref_ids))
        rows = upgrade(latest(rows))
        return rows.select("ref_id", *[c for c in columns if c != "ref_id"]) if columns else rows


def inline_table(json: Column, fields: list[str]) -> Column:
    """Array of structs of ``fields`` (strings) of a table inside a digest: an array of objects.

    Older digests have it transposed: a row a field, in the order of ``fields``, and columns V1, V2, ... for the table's rows.
    """
    rows = F.from_json(json, "array<map<string,string>>")
    own = lambda r: F.struct(*[F.element_at(r, f).alias(f) for f in fields])
    columns = F.array_sort(F.filter(F.map_keys(F.get(rows, F.lit(0))), lambda k: k.rlike(r"^V\d+$")), lambda a, b: F.substring(a, 2, 9).cast("int") - F.substring(b, 2, 9).cast("int"))
    turned = F.transform(columns, lambda k: F.struct(*[F.element_at(F.get(rows, F.lit(i)), k).alias(f) for i, f in enumerate(fields)]))
    return F.when(F.size(columns) > 0, turned).otherwise(F.transform(rows, own))


#: What a release manifest of the digest schema has to name.
RELEASE = ("schema_version", "prompt_version", "released_at")


def release(manifest: dict) -> dict:
    """A release manifest, checked: all of ``RELEASE`` are there, and the schema version is one of ``VERSIONS``."""
    absent = [k for k in RELEASE if not manifest.get(k)]
    if absent:
        raise ValueError(f"the manifest lacks {', '.join(absent)}")
    if manifest["schema_version"] not in VERSIONS:
        raise ValueError(f"unknown schema version {manifest['schema_version']}")
    return manifest
