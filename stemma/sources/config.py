"""Collections of a project: a small configuration that the driver holds."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REQUIRED = ("collection_id", "collection_type", "title", "remote_channel", "local_path")
SCHEMA = ", ".join(f"{n} string" for n in REQUIRED) + ", metadata map<string,string>, sync map<string,string>, seq int"
ROOT_VARIABLE = "STEMMA_DATA_ROOT"
DEFAULT = {"version": 1, "collections": []}


def path(root: str | None = None) -> Path:
    found = root or os.environ.get(ROOT_VARIABLE)
    if not found:
        raise ValueError(f"no data root: pass one or set {ROOT_VARIABLE}")
    return Path(found) / "config.json"


def init(root: str | None = None) -> Path:
    """Write a default configuration; an existing one is an error."""
    at = path(root)
    if at.exists():
        raise FileExistsError(at)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(DEFAULT, indent=2))
    return at


def parse(text: str) -> dict:
    """JSON, or YAML where that library is installed."""
    text = text.replace("\t", "  ")
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def load(at: str | Path) -> dict:
    """A configuration, checked; older ones call collections journals; of equal ids the last counts."""
    found = parse(Path(at).read_text())
    rows = found.get("collections") or found.get("journals") or []
    by_id: dict[str, dict] = {}
    for row in rows:
        row = dict(row)
        row.setdefault("collection_id", row.pop("journal_id", None))
        missing = [k for k in REQUIRED if not row.get(k)]
        if missing:
            raise ValueError(f"collection {row.get('collection_id')}: {', '.join(missing)} missing")
        by_id.pop(row["collection_id"], None)
        by_id[row["collection_id"]] = row
    return {**found, "collections": list(by_id.values())}


def collections(spark: SparkSession, config: dict) -> DataFrame:
    text = lambda m: {k: json.dumps(v) if isinstance(v, dict | list) else str(v) for k, v in (m or {}).items()}
    rows = [(*(r[k] for k in REQUIRED), text(r.get("metadata")), text(r.get("sync")), i) for i, r in enumerate(config["collections"])]
    return spark.createDataFrame(rows, SCHEMA)


def journals(spark: SparkSession, config: dict) -> DataFrame:
    """The same under the older name of the id."""
    return collections(spark, config).withColumnRenamed("collection_id", "journal_id")


def query_set(at: str | Path) -> dict:
    """Categories and keywords of a CSV (``category_id,lexical_keywords``, keywords parted by ``|``), JSON or YAML file."""
    text = Path(at).read_text()
    if str(at).endswith(".csv"):
        import csv
        import io

        out: dict[str, list[str]] = {}
        for row in csv.DictReader(io.StringIO(text)):
            out.setdefault(row["category_id"], []).extend(k.strip() for k in (row.get("lexical_keywords") or "").split("|") if k.strip())
        return out
    return parse(text)
