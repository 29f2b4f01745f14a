"""Manifests: the planes of a bundle nested into one document with one spelling."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.functions import text as T

SCHEMA_VERSION = "1.4.0"
TOOL_VERSION = "0.2.0"


def _nest(rows: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """(root, name): the rows of each bundle as a sorted list without repeats; fields in the order that sorts them."""
    return rows.groupBy("root").agg(F.sort_array(F.collect_set(F.struct(*fields))).alias(name))


def manifests(bundles: DataFrame, inventory: DataFrame, capabilities: DataFrame, instructions: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row a bundle, with ``json``: keys sorted at every level, lists sorted and without repeats, what is absent left out.

    bundles: root, content_digest, description and, where they are known, declared (capabilities that the frontmatter names) and resolver. Lists that a bundle has nothing for are empty, not missing.
    """
    declared = F.array_sort(F.array_distinct(F.coalesce("declared", F.array().cast("array<string>")))) if "declared" in bundles.columns else F.array().cast("array<string>")
    resolver = F.col("resolver") if "resolver" in bundles.columns else F.lit("agent-skills")
    inv = _nest(inventory.withColumn("sha256", T.wire(F.col("sha256"))), "inventory", ["path", "load_phase", "parse_status", "parsed_as", "sha256", "size"])
    cap = _nest(capabilities.withColumn("detail", F.when(F.col("paths").isNotNull(), F.struct("paths"))), "capabilities", [F.col("term").alias("capability"), "detail", "evidence", "reachability"])
    ins = _nest(instructions, "instructions", ["signal", "evidence"])
    unr = _nest(unresolved, "unresolved", "file start_byte end_byte start_line reason note".split())
    phases = inventory.groupBy("root").agg(F.count_if(F.col("load_phase") == "reference").alias("reference_files"), F.count_if(F.col("load_phase") == "unreferenced").alias("unreferenced_files"))
    out = bundles.join(phases, "root", "left")
    for part, name in ((inv, "inventory"), (cap, "capabilities"), (ins, "instructions"), (unr, "unresolved")):
        out = out.join(part, "root", "left").withColumn(name, F.coalesce(name, F.from_json(F.lit("[]"), part.schema[name].dataType)))
    disclosure = F.struct(declared.alias("declared_capabilities"), F.octet_length("description").cast("long").alias("description_bytes"), F.coalesce("reference_files", F.lit(0)).alias("reference_files"), T.trigger_terms(F.col("description")).alias("trigger_terms"), F.coalesce("unreferenced_files", F.lit(0)).alias("unreferenced_files"))
    target = F.struct("content_digest", F.lit("skill").alias("kind"), F.col("root").alias("name"), resolver.alias("resolver"), F.col("root"))
    tool = F.struct(F.lit("capledger").alias("name"), F.lit(TOOL_VERSION).alias("version"))
    doc = F.struct(F.struct(F.lit(False).alias("enabled")).alias("advisory"), "capabilities", disclosure.alias("disclosure"), "instructions", "inventory", F.lit(SCHEMA_VERSION).alias("schema_version"), target.alias("target"), tool.alias("tool"), "unresolved")
    return out.select("root", F.to_json(doc).alias("json"))


def canonical(x):
    """A document in its one form: keys sorted, what is absent or null left out, lists sorted by their members' own form and without repeats. Doing it again changes nothing."""
    if isinstance(x, dict):
        return {k: canonical(v) for k, v in sorted(x.items()) if v is not None}
    if not isinstance(x, list):
        return x
    once = {json.dumps(v, sort_keys=True, ensure_ascii=False): v for v in map(canonical, x)}
    return [once[k] for k in sorted(once, key=lambda k: _place(once[k], k))]


#: What lists of objects are sorted by first.
_FIRST = ("file", "start_byte", "end_byte", "path", "capability", "signal", "kind")


def _place(v, text: str) -> tuple:
    if not isinstance(v, dict):
        return ((), text)
    return (tuple((k not in v, str(type(v.get(k)).__name__), v.get(k, 0)) for k in _FIRST), text)


def _clean(x):
    if isinstance(x, dict):
        return {k: _clean(v) for k, v in sorted(x.items()) if v is not None}
    return [_clean(v) for v in x] if isinstance(x, list) else x


def framed(documents: list[str]) -> str:
    """A JSON array of manifests in the one accepted spelling: two spaces, keys sorted, a newline at the end."""
    return json.dumps([_clean(json.loads(d)) for d in documents], sort_keys=True, indent=2, ensure_ascii=False) + "\n"
