"""Queries of the evaluation side: documents stand for bundles, ``labels`` for what people said of them, languages for strata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.functions import text as T
from capledger.operators import advisory, evaluation, gates, planes
from capledger.plans import oracles as O
from capledger.plans.detection import FAMILIES, _pick, _written, parts
from capledger.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
TERMS = ("net.egress", "code.obfuscation", "process.exec")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: What is detected in a bundle: its markers; the first line describes it; quotes in it can't be told.
_FOUND = (("net.egress", "@mail"), ("code.obfuscation", "%%%"), ("process.exec", "!! "), ("code.dynamic_eval", " | "), ("env.read.secret", "icense"))
_BASE = f"""WITH b AS (SELECT doc_id, lang AS stratum, n_chars >= 200 AS scanned, list_filter([{', '.join(f"CASE WHEN contains(text, '{m}') THEN '{t}' END" for t, m in _FOUND)}], lambda x: x IS NOT NULL) AS terms,
    CASE WHEN contains(text, chr(10)) THEN octet_length(encode(split_part(text, chr(10), 1))) ELSE 0 END AS described, contains(text, '"')::INTEGER AS open_, n_chars FROM documents),
l AS (SELECT b.*, CASE WHEN n_chars > 9000 THEN 'too_large' ELSE 'labelled' END AS verdict, list_filter([CASE WHEN toxic = 1 THEN 'net.egress' END, CASE WHEN quality = 0 THEN 'code.obfuscation' END, CASE WHEN quality = 0 THEN 'process.exec' END], lambda x: x IS NOT NULL) AS truth, quality = 0 AS delta FROM labels JOIN b USING (doc_id)),
s AS (SELECT * FROM l WHERE verdict = 'labelled' AND scanned AND stratum IN ('en', 'fr', 'de'))"""
STRATA = ["en", "fr", "de"]


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(labels, bundles); what a label needs of its document is a narrow table, so that no text is joined."""
    terms = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(m)), F.lit(t)) for t, m in _FOUND)))
    described = F.when(F.contains("text", F.lit("\n")), F.octet_length(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)))).otherwise(0)
    facts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("digest"), F.col("lang").alias("stratum"), "n_chars", terms.alias("terms"), described.cast("long").alias("description_bytes"), F.contains("text", F.lit('"')).cast("int").alias("unresolved"))
    said = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("digest"), "quality", "toxic").join(facts.select("digest", "stratum", "n_chars"), "digest")
    truth = F.array_compact(F.array(F.when(F.col("toxic") == 1, "net.egress"), F.when(F.col("quality") == 0, "code.obfuscation"), F.when(F.col("quality") == 0, "process.exec")))
    labels = said.select("digest", "stratum", F.when(F.col("n_chars") > 9000, "too_large").otherwise("labelled").alias("verdict"), truth.alias("capabilities"), (F.col("quality") == 0).alias("disclosure_delta"))
    return labels, facts.where("n_chars >= 200").select("digest", "terms", "description_bytes", "unresolved")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.scored(*_labelled(spark, d), STRATA)[0]


@query(_BASE + " SELECT count(*) FILTER (WHERE verdict = 'labelled' AND scanned AND stratum IN ('en', 'fr', 'de')) AS scored, count(*) FILTER (WHERE verdict <> 'labelled' OR (stratum IN ('en', 'fr', 'de') AND NOT scanned)) AS unscoreable FROM l")
def scored_bundles(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.scored(*_labelled(spark, d), STRATA)[1]


_RATE = "hits, total, round(hits / total, 9) AS rate"


@query(_BASE + f", g AS (SELECT stratum, count(*) FILTER (WHERE len(list_filter(terms, lambda t: t IN ({O.listed(TERMS)}) AND NOT list_contains(truth, t))) > 0) AS hits, count(*) AS total FROM s GROUP BY stratum) SELECT stratum, {_RATE} FROM g")
def spurious_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.spurious(_rows(spark, d), list(TERMS)).select("stratum", "hits", "total", "rate")


@query(_BASE + f", g AS (SELECT stratum, count(*) FILTER (WHERE delta AND described > 0) AS hits, count(*) FILTER (WHERE described > 0) AS total FROM s GROUP BY stratum) SELECT stratum, {_RATE} FROM g WHERE total > 0")
def disclosure_deltas(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.deltas(_rows(spark, d)).select("stratum", "hits", "total", "rate")


@query(_BASE + f", g AS (SELECT stratum, count(*) FILTER (WHERE described = 0) AS hits, count(*) AS total FROM s GROUP BY stratum) SELECT stratum, {_RATE} FROM g")
def undescribed_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.undescribed(_rows(spark, d)).select("stratum", "hits", "total", "rate")


@query(_BASE + f", g AS (SELECT count(*) FILTER (WHERE open_ > 0) AS hits, count(*) AS total FROM s) SELECT {_RATE} FROM g")
def unresolved_rate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.unresolved_rate(_rows(spark, d)).select("hits", "total", "rate")


@query(_BASE + f", u AS (SELECT doc_id, unnest(terms) AS term FROM s) SELECT term, count(*) AS bundles FROM u WHERE term NOT IN ({O.listed(TERMS)}) GROUP BY term")
def unlabelled_terms(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.unmeasured(_rows(spark, d), list(TERMS))


@query(_BASE + f", c AS (SELECT u.term, list_contains(terms, u.term) AS p, list_contains(truth, u.term) AS a FROM s, (SELECT unnest([{O.listed(TERMS)}]) AS term) u) SELECT term, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn, count(*) FILTER (WHERE NOT p AND NOT a) AS tn FROM c GROUP BY term")
def labelled_scores(spark: SparkSession, d: str) -> DataFrame:
    from capledger.operators import corpus

    return corpus.confusion(evaluation.term_cells(_rows(spark, d), list(TERMS))).select("term", "tp", "fp", "fn", "tn")


@query("""WITH x AS (SELECT doc_id // 2 AS k, quality, toxic FROM labels), t AS (SELECT k::VARCHAR AS digest, 'labelled twice' AS problem FROM x GROUP BY k HAVING count(*) > 1)
SELECT * FROM t UNION ALL SELECT DISTINCT k::VARCHAR, 'unknown term quality.low' FROM x WHERE quality = 0""")
def label_problems(spark: SparkSession, d: str) -> DataFrame:
    """Two neighbouring documents share a label, and one term isn't in the vocabulary."""
    terms = F.array_compact(F.array(F.when(F.col("quality") == 0, "quality.low"), F.when(F.col("toxic") == 1, "net.egress")))
    labels = table(spark, d, "labels").select(F.floor(F.col("doc_id") / 2).cast("long").cast("string").alias("digest"), terms.alias("capabilities"))
    return evaluation.label_problems(labels, list(TERMS))


_STRATUM = "CASE WHEN contains(text, '@mail') THEN 'code_credential' WHEN n_chars < 1000 THEN 'prose_only' ELSE 'code_clean' END"
_LEFT = f"""WITH i AS (SELECT doc_id, 'sha256:' || sha256(doc_id::VARCHAR) AS digest, {_STRATUM} AS stratum FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7' || digest), digest)::INTEGER AS position FROM i ANTI JOIN labels USING (doc_id)),
dr AS (SELECT * FROM r WHERE position <= {O.QUOTA})"""


def _drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from capledger.operators import corpus

    stratum = F.when(F.contains("text", F.lit("@mail")), "code_credential").when(F.col("n_chars") < 1000, "prose_only").otherwise("code_clean")
    digest = T.wire(T.sha256(F.col("doc_id").cast("string"))).alias("digest")
    items = table(spark, d, "documents").select("doc_id", digest, stratum.alias("stratum"))
    return items, evaluation.strata_draw(items, table(spark, d, "labels").select(digest), "7", corpus.QUOTAS)


@query(_LEFT + " SELECT doc_id, stratum, position FROM dr")
def unlabelled_draw(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d)[1].select("doc_id", "stratum", "position")


@query(_LEFT + " SELECT stratum, count(*) AS population, (SELECT count(*) FROM dr WHERE dr.stratum = i.stratum) AS drawn FROM i GROUP BY stratum")
def stratum_populations(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.populations(*_drawn(spark, d))


#: All kinds of assertion, about planes made from orders: whether each holds.
_KINDS = (
    ("capability", {"capability": "net.egress"}, "o_orderkey % 3 = 0"),
    ("capability", {"capability": "net.egress", "reachability": "observed"}, "o_orderkey % 3 = 0 AND o_orderkey % 2 = 0"),
    ("unresolved", {"reason": "computed_target"}, "o_orderkey % 5 = 0"),
    ("load_phase", {"path": "a.md", "phase": "reference"}, "o_orderkey % 2 = 1"),
    ("instruction", {"signal": "instruction.exec_directive"}, "o_orderkey % 4 = 0"),
    ("escalation", {"capability": "net.egress"}, "o_orderkey % 3 = 0 AND o_orderkey % 7 > 0"),
    ("no_capability", {}, "o_orderkey % 3 > 0"),
    ("no_instruction", {}, "o_orderkey % 4 > 0"),
    ("no_verdict", {}, "o_orderkey % 11 > 0"),
)


def _held(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    x = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("root"), F.col("o_orderkey").alias("k"))
    caps = x.where(k % 3 == 0).select("root", F.lit("net.egress").alias("term"), F.when(k % 2 == 0, "observed").otherwise("present").alias("reachability"))
    files = x.select("root", F.lit("a.md").alias("path"), F.when(k % 2 == 1, "reference").otherwise("unreferenced").alias("load_phase"))
    signals = x.where(k % 4 == 0).select("root", F.lit("instruction.exec_directive").alias("signal"))
    open_ = x.where(k % 5 == 0).select("root", F.lit("computed_target").alias("reason"))
    json_ = x.select("root", F.when(k % 11 == 0, F.lit('{"note": "suspicious"}')).otherwise(F.lit('{"v": "1.5", "n": 3}')).alias("json"))
    added = x.where((k % 3 == 0) & (k % 7 > 0)).select("root", F.lit("capability_added").alias("kind"), F.lit("net.egress").alias("capability"))
    fields = ("capability", "reachability", "reason", "path", "phase", "signal")
    rows = F.array(*(F.struct(F.concat("root", F.lit(f"-{n}")).alias("case"), F.lit(kind).alias("kind"), *(F.lit(about.get(f)).cast("string").alias(f) for f in fields)) for n, (kind, about, _) in enumerate(_KINDS)))
    return gates.hold(x.select("root", F.explode(rows).alias("e")).select("root", "e.*"), files, caps, signals, open_, json_, added)


@query("SELECT o_orderkey || '-' || u.n AS \"case\", u.kind, u.ok FROM (SELECT o_orderkey, unnest([" + ", ".join(f"{{'n': {n}, 'kind': '{kind}', 'ok': {ok}}}" for n, (kind, _, ok) in enumerate(_KINDS)) + "]) AS u FROM orders)")
def expectation_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d).select("case", "kind", "ok")


_SUITES = "WITH c AS (SELECT o_orderpriority AS suite, o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderkey % 3 = 0 THEN 'passed' ELSE 'failed' END AS outcome FROM orders)"


@query("SELECT o_orderkey::VARCHAR AS \"case\", CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'passed' ELSE 'failed' END AS outcome FROM orders")
def case_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A case of two expectations for each order; those that need a model are pending."""
    o = table(spark, d, "orders")
    cases = o.select(F.col("o_orderkey").cast("string").alias("case"), F.when(F.col("o_orderstatus") == "P", "model").otherwise("available").alias("requires"))
    held = o.select(F.col("o_orderkey").cast("string").alias("case"), F.explode(F.array(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 2 == 0)).alias("ok"))
    return gates.outcomes(cases, held, "adversarial").select("case", "outcome")


_ALL = [(term, lang, text, fires) for term, cases in FAMILIES.values() for lang, text, fires in cases]


@query(f"SELECT p_partkey::VARCHAR AS fixture, [{', '.join(str(f).lower() for *_, f in _ALL)}][p_partkey % {len(_ALL)} + 1] AS positive FROM part")
def fixture_polarity(spark: SparkSession, d: str) -> DataFrame:
    """All rules' examples one after the other: those that are to fire, do; the others may for another rule's sake, and are held to their own."""
    key = F.col("p_partkey")
    text = _written([t for _, _, t, _ in _ALL], key, F.col("p_name"))
    f = parts(spark, d, "p_partkey", "p_name").select(key.cast("string").alias("root"), F.lit("run").alias("path"), _pick([F.lit(lang) for _, lang, _, _ in _ALL], key).alias("language"), F.lit(True).alias("entered"), text.alias("text"))
    found = planes.findings(planes.events(f)).where("outcome = 'hit'").select("root", "term").distinct()
    want = table(spark, d, "part").select(key.cast("string").alias("root"), _pick([F.lit(t) for t, *_ in _ALL], key).alias("term"))
    hit = want.join(found.withColumn("hit", F.lit(True)), ["root", "term"], "left")
    return hit.select(F.col("root").alias("fixture"), F.coalesce("hit", F.lit(False)).alias("positive"))


_SILENT = ('x = "{n}"\n', "print({k})\n")
_LOUD = ("eval(x{k})\n", "def (\n", "import sys\nopen(sys.argv[{k}])\n")


@query("SELECT p_partkey::VARCHAR AS fixture, p_partkey % 5 >= 2 AS fires FROM part")
def fixture_fires(spark: SparkSession, d: str) -> DataFrame:
    """A finding, a file that can't be parsed and a target that can't be told are all something."""
    key = F.col("p_partkey")
    text = _written([*_SILENT, *_LOUD], key, F.col("p_name"))
    return gates.fires(parts(spark, d, "p_partkey", "p_name").select(key.alias("fixture"), F.lit("run.py").alias("path"), F.lit("python").alias("language"), text.alias("text")))


@query("SELECT source AS root, count(*) AS files FROM documents WHERE text <> '' GROUP BY source")
def chunked_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file with a text is cut into sections, whatever its length."""
    f = table(spark, d, "documents").select(F.col("source").alias("root"), F.col("doc_id").cast("string").alias("path"), "text")
    return advisory.section_sizes(f).groupBy("root").agg(F.count_distinct("path").alias("files"))


@query("""WITH RECURSIVE c AS (SELECT user_id, event_id AS path, 1 + event_id % 40 AS n, row_number() OVER (PARTITION BY user_id ORDER BY lpad(event_id::VARCHAR, 9, '0')) AS k FROM events),
b AS (SELECT user_id, path, n, k, n <= 100 AS taken, CASE WHEN n <= 100 THEN 100 - n ELSE 100 END AS left_ FROM c WHERE k = 1
UNION ALL SELECT c.user_id, c.path, c.n, c.k, c.n <= left_, CASE WHEN c.n <= left_ THEN left_ - c.n ELSE left_ END FROM b JOIN c ON c.user_id = b.user_id AND c.k = b.k + 1)
SELECT user_id::VARCHAR AS root, path::VARCHAR AS path, taken FROM b""")
def content_budget(spark: SparkSession, d: str) -> DataFrame:
    """A chunk for each event of a user, against a budget of 100 bytes."""
    c = table(spark, d, "events").select(F.col("user_id").cast("string").alias("root"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("path"), F.lit(1).cast("long").alias("start_line"), (F.col("event_id") % 40 + 1).cast("int").alias("bytes"))
    return advisory.budgeted(c, 100).select("root", F.col("path").cast("long").cast("string").alias("path"), "taken")


@query("SELECT event_id::VARCHAR AS root, 'semantic_call_failed' AS code FROM events WHERE event_type = 'click'")
def failed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Clicks get no answer."""
    r = table(spark, d, "events").select(F.col("event_id").cast("string").alias("root"), F.when(F.col("event_type") != "click", F.lit(json.dumps({"findings": []}))).alias("response"))
    return advisory.failed_calls(r).select("root", "code")


_SAID = [*O.KINDS, "excess_scope", "", "Injection_Attempt"]


@query(f"SELECT event_id, [{O.listed(_SAID)}][event_id % {len(_SAID)} + 1] AS kind FROM events WHERE event_id % {len(_SAID)} < {len(O.KINDS)}")
def advisory_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds that are known, as they are written, and no others."""
    texts = [json.dumps({"findings": [{"kind": k, "claim": "reaches further", "evidence": [{"file": "a.md", "start_line": 1}]}]}) for k in _SAID]
    r = table(spark, d, "events").select(F.col("event_id").cast("string").alias("root"), _pick(list(map(F.lit, texts)), F.col("event_id")).alias("response"))
    return advisory.validate(r, r.select("root", F.lit("a.md").alias("file"), F.lit(3).alias("line_count"))).select(F.col("root").cast("long").alias("event_id"), "kind")
