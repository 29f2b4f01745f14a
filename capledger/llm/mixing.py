"""Mixing sources to target weights: budgets go down a domain-language-source tree, and every leaf gives the token prefix of its seeded epochs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capledger.llm.common import local_table, materialize

LEVELS = ("domain", "lang", "source")
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Relative weights of siblings; those not listed have ``rest``. A leaf is read at most ``max_epochs`` times; the budget is ``ratio`` times all tokens."""

    domains: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"web": tuple(f"src{i}" for i in range(8)), "books": tuple(f"src{i}" for i in range(8, 12)), "news": tuple(f"src{i}" for i in range(12, 16)), "reference": tuple(f"src{i}" for i in range(16, 20))})
    domain: dict[str, float] = field(default_factory=lambda: {"web": 9.0, "books": 4.0, "news": 4.0, "reference": 3.0})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 11.0, "fr": 3.0, "de": 3.0, "es": 3.0})
    source: dict[str, float] = field(default_factory=dict)
    rest: float = 1.0
    max_epochs: int = 2
    ratio: float = 1.0
    seed: int = 11


def _leaf(mix: Mix, lang: Column, source: Column) -> list[Column]:
    source = F.coalesce(source.cast("string"), F.lit("unknown"))
    domain = F.lit("other")
    for d, names in mix.domains.items():
        domain = F.when(source.isin(*names), F.lit(d)).otherwise(domain)
    return [domain.alias("__domain"), F.coalesce(lang.cast("string"), F.lit("unknown")).alias("__lang"), source.alias("__source")]


def tokens(text: Column) -> Column:
    """Words between white space; none in a null text."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def share(budget: float, children: list[tuple[str, float, float]]) -> dict[str, float]:
    """Divide a budget in proportion to weight, none above its capacity: what a child can't take goes to its siblings. children: (name, weight, capacity)."""
    order = sorted((c for c in children if c[1] > 0), key=lambda c: (c[2] / c[1], c[0]))
    before, got = 0.0, {c[0]: 0.0 for c in children}
    for i, (name, weight, cap) in enumerate(order):
        rest = sum(c[1] for c in order[i:])
        if cap * rest <= (budget - before) * weight:
            got[name] = cap
            before += cap
        else:
            level = (budget - before) / rest
            got |= {c[0]: c[1] * level for c in order[i:]}
            break
    return got


def budgets(mix: Mix, supply: dict[tuple[str, str, str], int]) -> dict[tuple[str, str, str], int]:
    """Whole tokens for each leaf. A shortage is met by siblings first; only what a whole subtree lacks goes to its parent's siblings."""
    out: dict[tuple, int] = {}

    def down(prefix: tuple, budget: float) -> None:
        level = len(prefix)
        if level == 3:
            out[prefix] = math.floor(budget + 1e-6)
            return
        caps: dict[str, int] = {}
        for leaf, n in supply.items():
            if leaf[:level] == prefix:
                caps[leaf[level]] = caps.get(leaf[level], 0) + n * mix.max_epochs
        listed = getattr(mix, LEVELS[level])
        for name, b in share(budget, [(k, listed.get(k, mix.rest), c) for k, c in sorted(caps.items())]).items():
            down((*prefix, name), b)

    down((), math.floor(sum(supply.values()) * mix.ratio))
    return out


def _key(mix: Mix, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))))


def plan(df: DataFrame, mix: Mix, id_col: str, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(narrow table of ids, leaves and tokens; one row a leaf with its whole epochs and the last key of the one that is cut)."""
    spark = df.sparkSession
    narrow = materialize(df.select(F.col(f"`{id_col}`").alias("__id"), *_leaf(mix, F.col(f"`{lang_col}`"), F.col(f"`{source_col}`")), tokens(F.col(f"`{text_col}`")).alias("__tokens")), "mix")
    leaves = ["__domain", "__lang", "__source"]
    # One row a leaf of the configured tree comes to the driver, whatever the number of documents.
    supply = {(r[0], r[1], r[2]): r[3] for r in narrow.groupBy(*leaves).agg(F.sum("__tokens")).collect()}
    rows = []
    for leaf, budget in budgets(mix, supply).items():
        if n := supply[leaf]:
            rows.append((*leaf, budget // n, budget % n))
    aims = local_table(spark, rows, "__domain string, __lang string, __source string, __whole long, __part long")
    keyed = narrow.join(aims, leaves).where("__part > 0").withColumn("__key", _key(mix, F.col("__whole"), F.col("__id"))).withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    w = Window.partitionBy(*leaves).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    by = keyed.groupBy(*leaves, "__part", "__bucket").agg(F.sum("__tokens").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    # The bucket in which the prefix ends is the last that begins below the aim.
    edge = by.where("__before < __part").groupBy(*leaves).agg(F.max_by(F.struct("__bucket", "__before"), "__bucket").alias("e")).select(*leaves, F.col("e.__bucket").alias("__bucket"), F.col("e.__before").alias("__before"))
    inside = keyed.join(edge, [*leaves, "__bucket"])
    v = Window.partitionBy(*leaves).orderBy("__key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*leaves, "__key")
    cut = inside.withColumn("__at", F.col("__before") + F.sum("__tokens").over(v) - F.sum("__tokens").over(same)).where("__at < __part").groupBy(*leaves).agg(F.max("__key").alias("__cut"))
    # One row a leaf again; as a local table it is small by the optimizer's own count, so rows that carry texts stay where they are.
    found = {(r[0], r[1], r[2]): r[3] for r in cut.collect()}
    return narrow, local_table(spark, [(*r, found.get(r[:3])) for r in rows], "__domain string, __lang string, __source string, __whole long, __part long, __cut string")


def _copies(rows: DataFrame, aims: DataFrame, mix: Mix) -> DataFrame:
    leaves = ["__domain", "__lang", "__source"]
    last = F.coalesce(_key(mix, F.col("__whole"), F.col("__id")) <= F.col("__cut"), F.lit(False)).cast("int")
    n = (F.col("__whole") + last).cast("int")
    return rows.join(aims, leaves).withColumn("__n", n).where("__n > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))


def mix_sources(df: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(doc_id, domain, lang, source, epoch, tokens)``: what each leaf of the tree gives to the mixture.

    Epochs below a leaf's whole ones have all its documents; the last has those before which, in the order of a seeded
    hash of the id, fewer tokens lie than are due. Rows with one id in one leaf (null ids too) are in or out
    together. A null language or source is named ``unknown``; texts without words, null ones too, count 0 tokens; a leaf
    that has no token at all gives nothing. An empty table gives none. Other columns are ignored, whatever their names.
    """
    mix = mix or Mix()
    narrow, aims = plan(df, mix, id_col, text_col, lang_col, source_col)
    return _copies(narrow, aims, mix).select(F.col("__id").alias("doc_id"), F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__epoch").alias("epoch"), F.col("__tokens").alias("tokens"))


def mixed(df: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of df that ``mix_sources`` chooses, once for each epoch, with the columns they have, which may have any names. No text is shuffled: leaves' cuts come to the rows."""
    mix = mix or Mix()
    _, aims = plan(df, mix, id_col, text_col, lang_col, source_col)
    names = [c.lower() for c in df.columns]
    plain = df.toDF(*(f"c{k}" for k in range(len(names))))
    at = {c: F.col(f"c{names.index(c.lower())}") for c in (id_col, lang_col, source_col)}
    rows = plain.select("*", at[id_col].alias("__id"), *_leaf(mix, at[lang_col], at[source_col]))
    return _copies(rows, aims, mix).select(plain.columns).toDF(*df.columns)


def mix_sql(mix: Mix | None = None) -> str:
    """``mix_sources`` for DuckDB."""
    mix = mix or Mix()

    def values(d: dict[str, float]) -> str:
        return ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in d.items()) or "('', 0.0::DOUBLE)"

    def level(name: str, col: str, parents: list[str], source: str) -> str:
        """Shares of the siblings at one level, given their parents' budgets in ``source``."""
        keys = [*parents, col]
        part = f"PARTITION BY {', '.join(parents)}" if parents else ""
        join = f"JOIN {source} b USING ({', '.join(parents)})" if parents else f"CROSS JOIN {source} b"
        listed = {"domain": mix.domain, "lang": mix.lang, "source": mix.source}[col]
        return f"""
{name}_c AS (SELECT {', '.join(keys)}, sum(tokens) * {mix.max_epochs}::DOUBLE AS cap FROM base GROUP BY {', '.join(keys)}),
{name}_w AS (SELECT c.*, b.budget, coalesce(v.w, {mix.rest}::DOUBLE) AS w FROM {name}_c c {join} LEFT JOIN (VALUES {values(listed)}) v(k, w) ON v.k = c.{col}),
{name}_o AS (SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {col} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
    sum(w) OVER ({part} ORDER BY cap / w, {col} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_w),
{name}_f AS (SELECT *, cap * rest <= (budget - before) * w AS full_ FROM {name}_o),
{name}_g AS (SELECT *, min(CASE WHEN NOT full_ THEN before END) OVER ({part}) AS b0, max(CASE WHEN NOT full_ THEN rest END) OVER ({part}) AS r0 FROM {name}_f),
{name} AS (SELECT {', '.join(keys)}, CASE WHEN full_ THEN cap ELSE w * ((budget - b0) / r0) END AS budget FROM {name}_g)"""

    dom = " ".join(f"WHEN coalesce(source, 'unknown') IN ({', '.join(repr(s) for s in names)}) THEN '{d}'" for d, names in mix.domains.items())
    return f"""
WITH base AS (SELECT doc_id, CASE {dom} ELSE 'other' END AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    coalesce(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')), 0)::BIGINT AS tokens FROM documents),
top AS (SELECT floor(sum(tokens) * {mix.ratio})::DOUBLE AS budget FROM base),
{level('l1', 'domain', [], 'top')},{level('l2', 'lang', ['domain'], 'l1')},{level('l3', 'source', ['domain', 'lang'], 'l2')},
supply AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS n FROM base GROUP BY ALL),
aims AS (SELECT domain, lang, source, floor(budget + 1e-6)::BIGINT // n AS whole, floor(budget + 1e-6)::BIGINT % n AS part FROM l3 JOIN supply USING (domain, lang, source) WHERE n > 0),
keyed AS (SELECT base.*, whole, part, md5('{mix.seed}|' || whole || '|' || coalesce(doc_id::VARCHAR, '')) AS k FROM base JOIN aims USING (domain, lang, source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(tokens) OVER (PARTITION BY domain, lang, source, k) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, unnest(range(whole + CASE WHEN part > 0 AND upto < part THEN 1 ELSE 0 END))::INTEGER AS epoch, tokens FROM summed
"""
