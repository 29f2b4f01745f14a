"""Measures over a corpus: structure, markers, governance, rates, strata, samples, scores and their intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capledger.functions import text as T
from capledger.sources.tables import kept, scratch
from capledger.functions.vocabulary import CORE_KEYS, EXECUTABLE, MARKERS, OTHER_MARKERS, QUOTAS, VERSION_KEYS  # noqa: F401

def counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(root, name): for each root a map from values of key to how many rows have them; two levels, so that no group is collected whole."""
    n = rows.groupBy("root", key).agg(F.count("*").alias("n"))
    return n.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n"))))).alias(name))


def structure(files: DataFrame, descriptions: DataFrame | None = None, unresolved: DataFrame | None = None) -> DataFrame:
    """One row a bundle. files: root, size, parsed_as, load_phase; descriptions: root, description; unresolved: root, reason. With these, the description's bytes and counts of reasons."""
    unread = F.col("load_phase") == "unreferenced"
    out = files.groupBy("root").agg(
        F.count("*").alias("files"),
        F.sum("size").alias("total_bytes"),
        F.coalesce(F.sum(F.when(F.col("load_phase") == "reference", F.col("size"))), F.lit(0).cast("long")).alias("reference_bytes"),
        F.coalesce(F.sum(F.when(unread, F.col("size"))), F.lit(0).cast("long")).alias("unreferenced_bytes"),
        F.bool_or(unread).alias("has_unreferenced"),
        F.bool_or(F.col("parsed_as").isin(*EXECUTABLE)).alias("has_scripts"),
    ).join(counted(files, "parsed_as", "languages"), "root")
    if descriptions is not None:
        out = out.join(descriptions.select("root", F.octet_length("description").cast("long").alias("description_bytes")), "root", "left").fillna(0, ["description_bytes"])
    if unresolved is not None:
        out = out.join(counted(unresolved, "reason", "unresolved"), "root", "left").withColumn("unresolved", F.coalesce("unresolved", F.create_map().cast("map<string,long>")))
    return out


def governance(files: DataFrame, heads: DataFrame) -> DataFrame:
    """(root, has_license, has_version, extra_frontmatter_keys, frontmatter_parsed). files: root, path; heads: root, ok, keys (of the entry document's frontmatter)."""
    name = F.upper(T.basename(F.col("path")))
    f = files.groupBy("root").agg(F.bool_or((name == "LICENSE") | F.startswith(name, F.lit("LICENSE."))).alias("has_license"))
    keys = F.when(F.coalesce("ok", F.lit(False)), F.coalesce("keys", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    h = f.join(heads.select("root", "ok", "keys"), "root", "left").withColumn("k", keys)
    version = T.any_of([F.array_contains("k", v) for v in VERSION_KEYS])
    return h.select("root", "has_license", version.alias("has_version"), F.array_sort(F.filter("k", lambda x: ~x.isin(*CORE_KEYS))).alias("extra_frontmatter_keys"), F.coalesce("ok", F.lit(False)).alias("frontmatter_parsed"))


def marker_hit(text: Column, name: str) -> Column:
    return T.any_of([T.contains_marker(text, n) for n in MARKERS[name]])


def flagged(texts: DataFrame) -> DataFrame:
    """The rows of texts with a column for each marker in place of the text, so that joins carry flags."""
    rest = [c for c in texts.columns if c != "text"]
    return texts.select(*rest, *(F.coalesce(marker_hit(F.col("text"), m), F.lit(False)).alias(m) for m in MARKERS))


def lexical(files: DataFrame) -> DataFrame:
    """(root, marker, hit, only_unreferenced), by one pass over the texts. files: root, load_phase, and text or what ``flagged`` makes of it."""
    seen = F.col("load_phase") != "unreferenced"
    hits = flagged(files.select("root", "load_phase", "text")) if "text" in files.columns else files
    wide = hits.groupBy("root").agg(*(F.bool_or(m).alias(m) for m in MARKERS), *(F.bool_or(F.col(m) & seen).alias(m + "_seen") for m in MARKERS))
    rows = F.array(*(F.struct(F.lit(m).alias("marker"), F.col(m).alias("hit"), (F.col(m) & ~F.col(m + "_seen")).alias("only_unreferenced")) for m in MARKERS))
    return wide.select("root", F.explode(rows).alias("x")).select("root", "x.*")


def stratum(has_code: Column, credential: Column, hidden: Column, other: Column) -> Column:
    """The first that holds; null where none does. Traffic alone is no other marker."""
    return F.when(has_code & credential & hidden, "disclosure_shape").when(has_code & credential, "code_credential").when(has_code & other, "code_other_marker").when(has_code, "code_clean").when(~credential & ~other, "prose_only")


def draw(items: DataFrame, seed: str, quotas: dict[str, int]) -> DataFrame:
    """A seeded sample: each stratum in the order of a hash of seed and digest, up to its quota. items: digest (wire), stratum.

    The rank is first held against the largest quota, a literal, by which every task keeps only so many of its rows before they are shuffled.
    """
    quota = F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col("stratum"))
    order = F.sha2(F.concat(F.lit(seed), F.col("digest")), 256)
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("__order", "digest"))
    ranked = items.where(F.col("stratum").isin(*quotas)).withColumn("__order", order).withColumn("position", rank).where(F.col("position") <= max(quotas.values()))
    return ranked.where(F.col("position") <= quota).drop("__order")


def first_of_each(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; the order must be total."""
    return items.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def middle_ppm(values: Column) -> Column:
    """The middle value, of two their mean cut to a whole: exact, by counts of the distinct values, which whole millionths bound, whatever the number of rows."""
    return F.floor(F.percentile(values, 0.5)).cast("long")


def frequency(items: DataFrame, key: str, per: str) -> DataFrame:
    """(key, bundles): how many distinct ``per`` have each key."""
    return items.groupBy(key).agg(F.count_distinct(per).alias("bundles"))


def confusion(cells: DataFrame) -> DataFrame:
    """Counts and Wilson intervals per term. cells: term, predicted, actual (booleans), a row for every scored bundle and term."""
    c = cells.groupBy("term").agg(F.count_if(F.expr("predicted and actual")).alias("tp"), F.count_if(F.expr("predicted and not actual")).alias("fp"), F.count_if(F.expr("not predicted and actual")).alias("fn"), F.count_if(F.expr("not predicted and not actual")).alias("tn"))
    p, pl, ph = T.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    r, rl, rh = T.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("term", "tp", "fp", "fn", "tn", p.alias("precision"), pl.alias("precision_low"), ph.alias("precision_high"), r.alias("recall"), rl.alias("recall_low"), rh.alias("recall_high"))


def stratified(rates: DataFrame) -> DataFrame:
    """(estimate, low, high) of a rate weighted by population, null where any stratum has fewer than 5 labels. rates: population, hits, total."""
    w = rates.withColumn("w", F.col("population") / F.sum("population").over(Window.partitionBy()))
    p = F.col("hits") / F.col("total")
    e = w.agg(F.sum(F.col("w") * p).alias("e"), F.sum(F.col("w") * F.col("w") * p * (1 - p) / F.col("total")).alias("v"), F.min("total").alias("least"))
    half = 1.959963984540054 * F.sqrt("v")
    ok = F.col("least") >= 5
    return e.select(F.when(ok, F.round("e", 9)).alias("estimate"), F.when(ok, F.round(F.greatest(F.col("e") - half, F.lit(0.0)), 9)).alias("low"), F.when(ok, F.round(F.least(F.col("e") + half, F.lit(1.0)), 9)).alias("high"))


def prng_sample(items: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows as Python's own generator draws them from the sorted keys: the same rows as ``random.Random(seed).sample(sorted(keys), n)``, in its order (``position``), without the keys ever coming to the driver.

    The generator draws places, which depend on the count alone; rows are numbered within ranges of the key, whose counts are one row a partition.
    """
    import random

    ranged = items.repartitionByRange(key).withColumn("__part", F.spark_partition_id())
    spark, held = items.sparkSession, scratch(items.sparkSession, "ranged")
    ranged = kept(ranged, held)
    counts = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    total, starts = 0, []
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    places = [(i, k) for k, i in enumerate(random.Random(seed).sample(range(total), min(n, total)))]
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    numbered = ranged.withColumn("__r", rank).join(spark.createDataFrame(starts, "__part int, __start long"), "__part").withColumn("__at", F.col("__r") + F.col("__start"))
    return numbered.join(spark.createDataFrame(places, "__at long, position int"), "__at").drop("__part", "__r", "__start", "__at")
