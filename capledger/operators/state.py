"""Digests, locks, the difference of two states, and the allowlist."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMS = tuple("code.dynamic_eval code.obfuscation env.read.secret fs.read.credential fs.read.outside_bundle fs.write.agent_config fs.write.outside_bundle net.egress net.fetch_then_execute process.exec process.exec.dynamic".split())
RANK = {"bundle_added": 0, "capability_added": 1, "capability_removed": 2, "bundle_removed": 3, "content_changed": 4}


def content_digest(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, content_digest): a Merkle root over the files of each group. files: keys, path, sha256 (hex)."""
    leaf = F.unhex(F.sha2(F.concat(F.col("path").cast("binary"), F.unhex(F.lit("00")), F.unhex("sha256")), 256))
    root = F.aggregate(F.array_sort(F.collect_list(F.struct(F.col("path").cast("binary").alias("p"), leaf.alias("l")))), F.unhex(F.lit("")), lambda a, x: F.concat(a, x["l"]))
    return files.groupBy(*keys).agg(F.sha2(root, 256).alias("content_digest"))


def build_lock(bundles: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(root, content_digest, capabilities): distinct terms sorted; bundles without any have an empty list."""
    terms = capabilities.groupBy("root").agg(F.array_sort(F.collect_set("term")).alias("capabilities"))
    return bundles.join(terms, "root", "left").withColumn("capabilities", F.coalesce("capabilities", F.array().cast("array<string>")))


def diff_locks(before: DataFrame, after: DataFrame) -> DataFrame:
    """(root, kind, capability, before, after): one row a change, by full outer join of the two states."""
    b = before.select("root", F.col("content_digest").alias("bd"), F.col("capabilities").alias("bc"))
    a = after.select("root", F.col("content_digest").alias("ad"), F.col("capabilities").alias("ac"))
    j = b.join(a, "root", "full_outer")
    none = F.lit(None).cast("string")

    def one(kind: str, cap: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), cap.alias("capability"), F.col("bd").alias("before"), F.col("ad").alias("after"))

    empty = F.array().cast("array<struct<kind:string,capability:string,before:string,after:string>>")
    both = F.col("bd").isNotNull() & F.col("ad").isNotNull()
    changes = F.concat(
        F.when(F.col("bd").isNull(), F.array(one("bundle_added", none))).otherwise(empty),
        F.when(F.col("ad").isNull(), F.array(one("bundle_removed", none))).otherwise(empty),
        F.when(F.col("ad").isNotNull(), F.transform(F.array_except("ac", F.coalesce("bc", F.array().cast("array<string>"))), lambda c: one("capability_added", c))).otherwise(empty),
        F.when(both, F.transform(F.array_except("bc", "ac"), lambda c: one("capability_removed", c))).otherwise(empty),
        F.when(both & (F.col("bd") != F.col("ad")), F.array(one("content_changed", none))).otherwise(empty),
    )
    return j.select("root", F.explode(changes).alias("c")).select("root", "c.*")


def change_rank(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), kind)


def ordered(changes: DataFrame) -> DataFrame:
    return changes.orderBy("root", change_rank(F.col("kind")), F.coalesce("capability", F.lit("")))


def escalations(changes: DataFrame) -> DataFrame:
    """Capabilities gained, and bundles that arrive with any."""
    w = Window.partitionBy("root")
    gained = changes.withColumn("gains", F.count_if(F.col("kind") == "capability_added").over(w))
    return gained.where((F.col("kind") == "capability_added") | ((F.col("kind") == "bundle_added") & (F.col("gains") > 0))).drop("gains")


def unanalysed(changes: DataFrame, code_files: DataFrame) -> DataFrame:
    """Content changes of bundles no code file of which could be read. code_files: root, code_files_read."""
    return changes.where("kind = 'content_changed'").join(code_files, "root", "left").where("coalesce(code_files_read, 0) = 0")


def check_policy(terms: Iterable[str]) -> None:
    """Unknown terms are an error, never ignored."""
    if unknown := sorted(set(terms) - set(TERMS)):
        raise ValueError(f"unknown capability in the policy: {', '.join(unknown)}")


def violations(capabilities: DataFrame, allow: DataFrame | None, allow_bundle: DataFrame | None) -> DataFrame:
    """Capabilities neither list permits. Allowing only adds; no policy at all (None) checks nothing, an empty one permits nothing."""
    if allow is None and allow_bundle is None:
        return capabilities.where("false")
    out = capabilities
    if allow is not None:
        out = out.join(allow.select("term"), "term", "left_anti")
    if allow_bundle is not None:
        out = out.join(allow_bundle.select("root", "term"), ["root", "term"], "left_anti")
    return out


def decide(escalated: bool, violated: bool) -> int:
    """0 nothing, 1 gained capabilities, 2 violations, 3 both; 4 is for what could not run."""
    return int(escalated) + 2 * int(violated)
