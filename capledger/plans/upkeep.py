"""Queries of discovery, ledger, archive and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.functions import text as T
from capledger.operators import advisory, gates
from capledger.plans import oracles as O
from capledger.sources import archive
from capledger.sources.tables import find_roots, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("SELECT 'agent-skills' AS resolver, '.claude/skills/' || s_name AS root FROM supplier WHERE s_suppkey % 3 < 2")
def discovered_bundles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    path = F.when(k == 0, F.concat(F.lit(".claude/skills/"), "s_name", F.lit("/SKILL.md"))).when(k == 1, F.concat(F.lit(".claude/skills/"), "s_name", F.lit("/Skill.MD"))).otherwise(F.concat(F.lit(".claude/skills/"), "s_name", F.lit("/deep/SKILL.md")))
    return archive.discover(table(spark, d, "supplier").select(path.alias("path")), "project")


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'kits/' || p_partkey ELSE 'kits/' || p_partkey || '/inner' END AS root FROM part")
def checkout_roots(spark: SparkSession, d: str) -> DataFrame:
    """Even parts' roots hold another one that doesn't count."""
    k = F.col("p_partkey").cast("string")
    inner = F.concat(F.lit("kits/"), k, F.lit("/inner/SKILL.md"))
    own = F.concat(F.lit("kits/"), k, F.when(F.col("p_partkey") % 2 == 0, "/SKILL.md").otherwise("/skill.md"))
    return find_roots(table(spark, d, "part").select(F.explode(F.array(own, inner)).alias("path")))


@query("SELECT c_mktsegment AS owner, c_name AS name, c_nationkey::VARCHAR AS commit, c_mktsegment || '__' || c_name || '__' || c_nationkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def ledger_misses(spark: SparkSession, d: str) -> DataFrame:
    """Customers stand for repositories, those with urgent orders for fetched ones."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("owner"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("commit"))
    had = c.join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return archive.unfetched(c, had).select("owner", "name", "commit", archive.cache_key(F.col("owner"), F.col("name"), F.col("commit")).alias("key"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS ordinal, arg_min(source, doc_id) AS source FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents SEMI JOIN labels USING (doc_id)) GROUP BY 1")
def archive_new(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    b = doc.select(T.sha256(F.col("text")).alias("digest"), F.col("doc_id").alias("ordinal"), "source")
    old = doc.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(T.sha256(F.col("text")).alias("digest"))
    return archive.unarchived(b, old).select("digest", "ordinal", "source")


_OUT = "CASE WHEN {k} % 31 = 0 THEN 'failed' WHEN {k} % 7 = 0 THEN 'pending' ELSE 'passed' END"


@query(f"""WITH b AS (SELECT event_type AS suite, event_id AS k, {_OUT.format(k='(event_id + 1)')} AS was FROM events WHERE event_id % 5 > 0), n AS (SELECT event_type AS suite, event_id AS k, {_OUT.format(k='event_id')} AS now FROM events WHERE event_id % 5 < 4),
j AS (SELECT coalesce(b.suite, n.suite) AS suite, coalesce(b.k, n.k) AS k, was, now FROM b FULL JOIN n ON b.suite = n.suite AND b.k = n.k),
w AS (SELECT suite, k AS "case", CASE WHEN now = 'failed' THEN 'failed' WHEN now IS NULL AND was <> 'pending' THEN 'no longer run' WHEN now = 'pending' AND coalesce(was, '') <> 'pending' THEN 'newly pending' END AS why FROM j) SELECT * FROM w WHERE why IS NOT NULL""")
def baseline_regressions(spark: SparkSession, d: str) -> DataFrame:
    """Events as cases: each is in the baseline, in the new run, or in both."""

    def outcome(k):
        return F.when(k % 31 == 0, "failed").when(k % 7 == 0, "pending").otherwise("passed").alias("outcome")

    e, i = table(spark, d, "events"), F.col("event_id")
    both = e.select(F.col("event_type").alias("suite"), i.alias("case"), outcome(i + 1), (i % 5).alias("m"), outcome(i).alias("now"))
    return gates.regressions(both.where("m > 0").select("suite", "case", "outcome"), both.where("m < 4").select("suite", "case", F.col("now").alias("outcome")))


_L, _R, _X = "<<<CAPLEDGER-UNTRUSTED", "CAPLEDGER-UNTRUSTED>>>", "[capledger: delimiter removed]"
#: Every text between two delimiters of the other side.
_OPEN = f"'{_R} ' || text || ' {_L}{_L}'"


@query(f"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) END::BIGINT AS lines,
    sha256('{_L}' || chr(10) || replace(replace({_OPEN}, '{_L}', '{_X}'), '{_R}', '{_X}') || chr(10) || '{_R}') AS quoted, 3 AS broken FROM documents""")
def quoted_lines(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit(_R + " "), "text", F.lit(f" {_L}{_L}"))
    return table(spark, d, "documents").select("doc_id", T.line_count(F.col("text")).alias("lines"), T.sha256(T.quoted(t)).alias("quoted"), T.delimiters(t).alias("broken"))


@query(f"SELECT event_id, [{', '.join(str(ok).lower() for _, ok in O.DOCUMENTS)}][event_id % {len(O.DOCUMENTS)} + 1] AS free FROM events")
def verdict_free(spark: SparkSession, d: str) -> DataFrame:
    doc = F.element_at(F.array(*(F.lit(x) for x, _ in O.DOCUMENTS)), (F.col("event_id") % len(O.DOCUMENTS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", gates.verdict_free(doc).alias("free"))


_BAD = " OR ".join(f"contains(lower(text), '{w}')" for w in O.VERDICTS)


@query(f"SELECT doc_id, NOT ({_BAD}) AS free FROM documents")
def verdict_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.size(gates.verdict_words(F.col("text"))) == 0).alias("free"))


@query(f"SELECT doc_id, list_bool_or(list_transform([{O.listed(O.PHRASES)}], lambda p: contains(lower(text || ' ' || [{O.listed(O.PHRASES)}, 'nothing', 'ignore', 'report findings'][doc_id % {len(O.PHRASES) + 3} + 1]), p))) AS directed FROM documents")
def auditor_directed(spark: SparkSession, d: str) -> DataFrame:
    """Texts with one of the phrases, or with none, in capitals at their end."""
    said = [p.upper() for p in O.PHRASES] + ["NOTHING", "IGNORE", "REPORT FINDINGS"]
    end = F.element_at(F.array(*map(F.lit, said)), (F.col("doc_id") % len(said) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", advisory.auditor_directed(F.concat("text", F.lit(" "), end)).alias("directed"))


@query("SELECT page_id, replace(url_encode(url || ' ä*~+'), '+', '%20') AS encoded FROM pages")
def url_encoded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.url_encode(F.concat("url", F.lit(" ä*~+"))).alias("encoded"))


@query("SELECT page_id, ends_with(h, '.example') OR ends_with(h, 'api.test') OR ends_with(h, 'org') AS listed FROM (SELECT page_id, regexp_extract(url, '://([^/:]*)', 1) AS h FROM pages)")
def host_suffixes(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/:]*)", 1)
    return table(spark, d, "pages").select("page_id", T.host_suffix(host, [".example", "api.test", "org"]).alias("listed"))
