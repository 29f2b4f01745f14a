"""Which files an entry document reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.functions import text as T
from capledger.sources.tables import kept, scratch


def mentions(files: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(root, src, dst): paths in a text that name a file of the bundle, from where the text lies or from the root. paths: root, path of all files, if not those of files."""
    token = files.where("text is not null").select("root", F.col("path").alias("src"), F.explode(T.path_tokens(F.col("text"))).alias("token"))
    here = F.when(T.parent_dir(F.col("src")) == "", F.col("token")).otherwise(F.concat(T.parent_dir(F.col("src")), F.lit("/"), F.col("token")))
    rooted = F.when(F.col("token").rlike(r"^[/~]|^\\"), F.lit(None).cast("string")).otherwise(T.resolve_path(here))
    dst = token.select("root", "src", F.explode(F.array(rooted, T.resolve_path(F.col("token")))).alias("dst")).where("dst is not null")
    return dst.join((files if paths is None else paths).select("root", F.col("path").alias("dst")), ["root", "dst"], "left_semi").select("root", "src", "dst").distinct()


def reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, path) of all that seeds reach along edges, seeds with them; cycles end. Rounds are as many as the longest shortest path.

    Each round is a folder of one table in the shared folder: rounds don't repeat one another or the reading of texts, and executors may be lost.
    """
    spark = seeds.sparkSession
    folder = scratch(spark, "reach")
    edges = kept(edges.select("root", "src", "dst"), f"{folder}/edges")
    front = kept(seeds.select("root", "path").distinct(), f"{folder}/seen/0")
    n = 0

    def seen() -> DataFrame:
        return spark.read.schema(front.schema).option("recursiveFileLookup", True).parquet(f"{folder}/seen")

    while not front.isEmpty():
        n += 1
        new = edges.join(front.withColumnRenamed("path", "src"), ["root", "src"]).select("root", F.col("dst").alias("path")).distinct()
        front = kept(new.join(seen(), ["root", "path"], "left_anti"), f"{folder}/seen/{n}")
    return seen()


def load_phases(files: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, path, load_phase): entry files are on_trigger, what they reach is reference, the rest unreferenced."""
    hit = reach(entries, edges).withColumn("hit", F.lit(True))
    entry = entries.select("root", "path").distinct().withColumn("entry", F.lit(True))
    return files.select("root", "path").join(entry, ["root", "path"], "left").join(hit, ["root", "path"], "left").select("root", "path", F.when(F.col("entry"), "on_trigger").when(F.col("hit"), "reference").otherwise("unreferenced").alias("load_phase"))


def escaping_refs(entry_text: DataFrame) -> DataFrame:
    """(root, token): code paths in an entry document that lead out of the bundle both ways."""
    token = entry_text.select("root", F.explode(T.path_tokens(F.col("text"))).alias("token"))
    return token.where(T.resolve_path(F.col("token")).isNull() & T.extension_of(F.col("token")).isin(*T.CODE_EXTENSIONS)).distinct()
