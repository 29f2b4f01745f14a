"""Where bundles come from and are kept: discovery roots, the ledger of what was fetched, the archive by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: resolver, scope, folder below the scope's base in which each bundle has a directory of its own
RESOLVERS = (("agent-skills", "project", ".claude/skills"), ("agent-skills", "user", ".claude/skills"))


def slug(owner: Column, name: Column) -> Column:
    return F.concat(owner, F.lit("/"), name)


def cache_key(owner: Column, name: Column, commit: Column) -> Column:
    """A moved commit is another key, so that it is fetched anew."""
    return F.concat_ws("__", owner, name, commit)


def discover(paths: DataFrame, scope: str) -> DataFrame:
    """(resolver, root): directories right below a discovery folder that hold an entry document in any case. paths: path, relative to the scope's base."""
    out = None
    for resolver, of, folder in RESOLVERS:
        if of != scope:
            continue
        root = F.regexp_extract("path", "^" + folder.replace(".", "[.]") + r"/([^/]+)/[^/]+\z", 1)
        hit = paths.where((root != "") & (F.lower(F.regexp_extract("path", r"([^/]*)\z", 1)) == "skill.md")).select(F.lit(resolver).alias("resolver"), F.concat(F.lit(folder + "/"), root).alias("root")).distinct()
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        raise ValueError(f"unknown scope {scope}")
    return out


def unfetched(repos: DataFrame, ledger: DataFrame) -> DataFrame:
    """Repositories whose pinned commit isn't in the ledger. Both: owner, name, commit."""
    key = ["owner", "name", "commit"]
    return repos.join(ledger.select(*key), key, "left_anti")


def record(ledger_path: str, fetched: DataFrame) -> None:
    """Add to the ledger what isn't there yet; an interrupted run goes on from there."""
    fetched.select("owner", "name", "commit").distinct().write.mode("append").parquet(ledger_path)


def unarchived(bundles: DataFrame, archived: DataFrame) -> DataFrame:
    """The first bundle of each digest that the archive lacks. bundles: digest, and an ordinal that settles which is first."""
    new = bundles.join(archived.select("digest").distinct(), "digest", "left_anti")
    return new.groupBy("digest").agg(F.min_by(F.struct(*(c for c in bundles.columns if c != "digest")), "ordinal").alias("b")).select("digest", "b.*")


def store(files: DataFrame, folder: str) -> str:
    """Write files of new digests, partitioned by the digest's first two digits, as one more part of the archive."""
    path = f"{folder}/part-{uuid.uuid4().hex}"
    files.withColumn("prefix", F.substring("digest", 1, 2)).repartition("prefix").write.partitionBy("prefix").parquet(path)
    return path
