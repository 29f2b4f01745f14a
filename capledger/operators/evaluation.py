"""What was detected against what people labelled: labels checked, bundles scored, rates by stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.functions import text as T
from capledger.operators import corpus
from capledger.sources.tables import read_toml

_HEADER = ("snapshot", "sample_seed", "labeller", "reviewed_by", "vocabulary", "terms_labelled", "terms_detected_unscored", "strata_scored")
LABEL = "digest string, stratum string, verdict string, capabilities array<string>, disclosure_delta boolean"


def check_header(vocabulary: list[str], scored: list[str], unscored: list[str]) -> None:
    """A term has to be in the vocabulary, and is scored or not, but not both."""
    known = set(vocabulary)
    if unknown := sorted((set(scored) | set(unscored)) - known):
        raise ValueError(f"terms that the vocabulary lacks: {unknown}")
    if both := sorted(set(scored) & set(unscored)):
        raise ValueError(f"terms both scored and not: {both}")


def label_problems(labels: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(digest, problem): digests labelled twice, and terms that the vocabulary lacks."""
    twice = labels.groupBy("digest").count().where("count > 1").select("digest", F.lit("labelled twice").alias("problem"))
    terms = labels.select("digest", F.explode("capabilities").alias("t")).where(~F.col("t").isin(*vocabulary)).distinct()
    return twice.unionByName(terms.select("digest", F.concat(F.lit("unknown term "), F.col("t")).alias("problem")))


def load_labels(spark, path: str) -> tuple[dict, DataFrame]:
    """(header, labels as a table) of a label file; what ``label_problems`` finds, and an unknown key, is an error."""
    x = read_toml(path)
    rows = x.pop("labels", x.pop("label", []))
    if extra := set(x) - set(_HEADER):
        raise ValueError(f"unknown key in the labels: {sorted(extra)}")
    check_header(x.get("vocabulary", []), x.get("terms_labelled", []), x.get("terms_detected_unscored", []))
    table = spark.createDataFrame([(r["digest"], r["stratum"], r["verdict"], r.get("capabilities", []), r.get("disclosure_delta", False)) for r in rows], LABEL)
    if bad := label_problems(table, x.get("vocabulary", [])).orderBy("digest", "problem").take(5):
        raise ValueError("; ".join(f"{r['digest']}: {r['problem']}" for r in bad))
    return x, table


def scored(labels: DataFrame, bundles: DataFrame, strata: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(labelled bundles that were scanned, one row with counts ``scored`` and ``unscoreable``).

    labels: digest, stratum, verdict, capabilities, disclosure_delta; bundles: digest, terms, description_bytes, unresolved. Unscoreable are those whose verdict isn't
    ``labelled``, in any stratum, and those of the strata scored that weren't scanned. No strata means all.
    """
    usable = F.col("verdict") == "labelled"
    own = usable & (F.lit(True) if not strata else F.col("stratum").isin(*strata))
    j = labels.join(bundles.withColumn("seen", F.lit(True)), "digest", "left")
    counts = j.agg(F.count_if(own & F.col("seen").isNotNull()).alias("scored"), F.count_if(~usable | (own & F.col("seen").isNull())).alias("unscoreable"))
    return j.where(own & F.col("seen").isNotNull()).drop("seen"), counts


def term_cells(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(digest, stratum, term, predicted, actual) for each scored bundle and term."""
    cells = F.array(*(F.struct(F.lit(t).alias("term"), F.array_contains("terms", t).alias("predicted"), F.array_contains("capabilities", t).alias("actual")) for t in terms))
    return rows.select("digest", "stratum", F.explode(cells).alias("c")).select("digest", "stratum", "c.*")


def unmeasured(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(term, bundles): what was detected that nobody labels, each bundle once a term."""
    return rows.select("digest", F.explode(F.array_distinct("terms")).alias("term")).where(~F.col("term").isin(*terms)).groupBy("term").agg(F.count("*").alias("bundles"))


def _rate(rows: DataFrame, by: list, hits: str, total: str) -> DataFrame:
    point, low, high = T.wilson(F.col("hits"), F.col("total"))
    return rows.groupBy(*by).agg(F.count_if(F.expr(hits)).alias("hits"), F.count_if(F.expr(total)).alias("total")).where("total > 0").select(*by, "hits", "total", point.alias("rate"), low.alias("low"), high.alias("high"))


def spurious(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(stratum, hits, total, rate, low, high): bundles with a scored term that nobody labelled."""
    extra = F.exists("terms", lambda t: t.isin(*terms) & ~F.array_contains("capabilities", t))
    return _rate(rows.withColumn("x", extra), ["stratum"], "x", "true")


def deltas(rows: DataFrame) -> DataFrame:
    """(stratum, ...): labelled disclosure deltas, of bundles that describe themselves at all."""
    return _rate(rows, ["stratum"], "disclosure_delta and description_bytes > 0", "description_bytes > 0")


def undescribed(rows: DataFrame) -> DataFrame:
    """(stratum, ...): bundles without a description."""
    return _rate(rows, ["stratum"], "description_bytes = 0", "true")


def unresolved_rate(rows: DataFrame) -> DataFrame:
    """(hits, total, rate, low, high): bundles of which something could not be told."""
    point, low, high = T.wilson(F.col("hits"), F.col("total"))
    return rows.agg(F.count_if(F.col("unresolved") > 0).alias("hits"), F.count("*").alias("total")).select("hits", "total", point.alias("rate"), low.alias("low"), high.alias("high"))


def strata_draw(items: DataFrame, labelled: DataFrame, seed: str, quotas: dict[str, int]) -> DataFrame:
    """A seeded sample of each stratum without what is labelled already. items: digest, stratum; labelled: digest."""
    return corpus.draw(items.join(labelled.select("digest").distinct(), "digest", "left_anti"), seed, quotas)


def populations(items: DataFrame, drawn: DataFrame) -> DataFrame:
    """(stratum, population, drawn): how many a stratum has and how many of them were taken."""
    n = items.where("stratum is not null").groupBy("stratum").agg(F.count("*").alias("population"))
    return n.join(drawn.groupBy("stratum").agg(F.count("*").alias("drawn")), "stratum", "left").fillna(0, ["drawn"])
