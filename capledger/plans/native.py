"""Queries of the operators that are plain plans: the driver's tables are projected into files, bundles, labels and snapshots. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.functions import text as T
from capledger.operators import corpus, graph, planes, state
from capledger.plans import oracles as O
from capledger.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
EXT = ("md", "py", "sh", "js", "ts", "json", "txt", "PY")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ext(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, EXT)), (i % len(EXT) + 1).cast("int"))


_EXT = "[" + ", ".join(f"'{e}'" for e in EXT) + "][doc_id % 8 + 1]"
#: A bundle is a source, a file a document, its phase and language follow from the id.
_FILES = f"""files AS (SELECT source AS root, lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.' || {_EXT} AS path, doc_id, text, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256,
    CASE doc_id % 8 WHEN 0 THEN 'markdown' WHEN 1 THEN 'python' WHEN 2 THEN 'shell' WHEN 3 THEN 'javascript' WHEN 4 THEN 'typescript' WHEN 5 THEN 'json' WHEN 6 THEN 'text' ELSE 'unknown' END AS parsed_as,
    CASE doc_id % 3 WHEN 0 THEN 'on_trigger' WHEN 1 THEN 'reference' ELSE 'unreferenced' END AS load_phase, lang FROM documents)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    path = F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("."), _ext(F.col("doc_id")))
    phase = F.element_at(F.array(*map(F.lit, ("on_trigger", "reference", "unreferenced"))), (F.col("doc_id") % 3 + 1).cast("int"))
    x = doc.select(F.col("source").alias("root"), path.alias("path"), "doc_id", "text", F.octet_length("text").cast("long").alias("size"), T.sha256(F.col("text")).alias("sha256"), phase.alias("load_phase"), "lang")
    return x.withColumn("parsed_as", T.language_of(F.col("path")))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS size, 'sha256:' || sha256(text) AS digest, sha256(text)[1:8] AS short, 'sha256:' || sha256(text) SIMILAR TO 'sha256:[0-9a-f]{64}' AS valid FROM documents")
def inventory_hash(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    w = T.wire(T.sha256(T.normalize_newlines(F.col("text"))))
    return doc.select("doc_id", F.octet_length(T.normalize_newlines(F.col("text"))).cast("long").alias("size"), w.alias("digest"), T.short_digest(w).alias("short"), T.is_wire(w).alias("valid"))


@query(f"WITH {_FILES} SELECT root, path, lower({_EXT}) AS extension, parsed_as FROM files")
def inventory_language(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("root", "path", T.extension_of(F.col("path")).alias("extension"), "parsed_as")


@query("SELECT doc_id, doc_id % 3 = 1 AND octet_length(encode(text)) < 8192 AS binary, doc_id % 3 < 2 AS utf8 FROM documents")
def binary_and_utf8_flags(spark: SparkSession, d: str) -> DataFrame:
    """Texts as they are, with a NUL put in, and cut within a character."""
    t = F.col("text").cast("binary")
    content = F.when(F.col("doc_id") % 3 == 0, t).when(F.col("doc_id") % 3 == 1, F.concat(t, F.unhex(F.lit("00")))).otherwise(F.concat(t, F.unhex(F.lit("C3"))))
    x = table(spark, d, "documents").select("doc_id", content.alias("content"))
    return x.select("doc_id", T.is_binary(F.col("content")).alias("binary"), F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"))


_DIGEST = "sha256(unhex(string_agg(sha256(encode(path) || '\\x00'::BLOB || unhex(sha256)), '' ORDER BY encode(path))))"


@query(f"WITH {_FILES} SELECT root, {_DIGEST} AS content_digest FROM files GROUP BY root")
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return state.content_digest(files(spark, d), "root")


@query("SELECT sha256(text) AS digest, arg_min(source, doc_id) AS first_source, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def duplicate_bundles(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").select(T.sha256(F.col("text")).alias("digest"), "source", "doc_id")
    return doc.groupBy("digest").agg(F.min(F.struct("doc_id", "source")).alias("m"), F.count("*").alias("copies")).select("digest", F.col("m.source").alias("first_source"), F.col("m.doc_id").alias("first_id"), "copies")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def repo_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return corpus.first_of_each(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"])


@query("""SELECT page_id, u.token FROM (SELECT page_id, unnest(list_distinct(list_filter(regexp_extract_all(html, '[A-Za-z0-9._/\\\\~+-]+'), lambda x: regexp_matches(x, '[/\\\\.]')))) AS token FROM pages) u""")
def path_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(T.path_tokens(F.col("html"))).alias("token"))


_NAMED = [(f"d/x.{e}", lang) for lang, es in O.EXTENSIONS.items() for e in es] + [("Dockerfile", "dockerfile"), ("a/Makefile", "make"), ("a.b/Makefile", "make"), ("Dockerfile.md", "markdown"), ("Makefile.x", "unknown"), ("LICENSE", "unknown"), (".md", "markdown"), ("a.py.txt", "text")]


@query(f"SELECT o_orderkey, [{O.listed(x for _, x in _NAMED)}][o_orderkey % {len(_NAMED)} + 1] AS language FROM orders")
def language_names(spark: SparkSession, d: str) -> DataFrame:
    """Every extension and name that is known, and some that aren't."""
    path = F.element_at(F.array(*(F.lit(p) for p, _ in _NAMED)), (F.col("o_orderkey") % len(_NAMED) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.language_of(path).alias("language"))


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'a/' || k WHEN 1 THEN 'c' || k WHEN 4 THEN 'w/' || k WHEN 7 THEN k END AS resolved,
    CASE o_orderkey % 8 WHEN 0 THEN 'a/./' WHEN 1 THEN 'a/..' WHEN 2 THEN 'a/../..' WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN '~' WHEN 6 THEN 'a' ELSE 'x/y/../..' END AS parent FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS k FROM orders)""")
def path_resolve(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    shapes = [F.concat(F.lit("a/.//"), k), F.concat(F.lit("a/../c"), k), F.concat(F.lit("a/../../"), k), F.concat(F.lit("/"), k), F.concat(F.lit("w\\"), k), F.concat(F.lit("~/"), k), F.lit("a/.."), F.concat(F.lit("x/y/../../"), k)]
    x = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*shapes), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("p"))
    return x.select("o_orderkey", T.resolve_path(F.col("p")).alias("resolved"), T.parent_dir(F.col("p")).alias("parent"))


_NODES = "n AS (SELECT source AS root, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, doc_id FROM documents)"
_PHASE = f"""WITH RECURSIVE {_NODES}, e AS (SELECT root, k AS src, unnest([2 * k, 3 * k + 1]) AS dst FROM n),
r AS (SELECT root, k FROM n WHERE k = 1 UNION SELECT e.root, e.dst FROM r JOIN e ON e.root = r.root AND e.src = r.k JOIN n ON n.root = e.root AND n.k = e.dst),
p AS (SELECT n.root, n.k::VARCHAR || '.md' AS path, CASE WHEN n.k = 1 THEN 'on_trigger' WHEN r.k IS NOT NULL THEN 'reference' ELSE 'unreferenced' END AS load_phase FROM n LEFT JOIN r ON r.root = n.root AND r.k = n.k)"""


def _phases(spark: SparkSession, d: str) -> DataFrame:
    """Document k of a source mentions documents 2k and 3k + 1, some by a path from the root, some by a relative one."""
    from pyspark.sql import Window

    n = table(spark, d, "documents").select(F.col("source").alias("root"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("k"))
    text = F.concat(F.lit("see ./"), (2 * F.col("k")).cast("string"), F.lit(".md and `x/../"), (3 * F.col("k") + 1).cast("string"), F.lit(".md`, not /1.md"))
    f = n.select("root", F.concat(F.col("k").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    return graph.load_phases(f, f.where("path = '1.md'"), graph.mentions(f))


@query(_PHASE + " SELECT root, path, load_phase FROM p")
def load_phase(spark: SparkSession, d: str) -> DataFrame:
    return _phases(spark, d)


_LEFT = [*O.OUTSIDE, "txt", "tsx", "rb", "go", "PY"]


@query(f"""WITH x AS (SELECT o_orderkey, [{O.listed(_LEFT)}][o_orderkey % {len(_LEFT)} + 1] AS e FROM orders)
SELECT o_orderkey::VARCHAR AS root, CASE o_orderkey % 4 WHEN 0 THEN '../run' || o_orderkey ELSE '/opt/x' || o_orderkey END || '.' || e AS token FROM x WHERE o_orderkey % 4 < 2 AND lower(e) IN ({O.listed(O.OUTSIDE)})""")
def escaping_refs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    e = F.element_at(F.array(*map(F.lit, _LEFT)), (F.col("o_orderkey") % len(_LEFT) + 1).cast("int"))
    text = F.element_at(F.array(F.concat(F.lit("run `../run"), k, F.lit("."), e, F.lit("` now")), F.concat(F.lit("python /opt/x"), k, F.lit("."), e, F.lit(", a/b.py")), F.concat(F.lit("read ../notes"), k, F.lit(".csv")), F.concat(F.lit("bin/"), k, F.lit(".py"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return graph.escaping_refs(table(spark, d, "orders").select(k.alias("root"), text.alias("text")))


_STOP = O.listed(O.STOP)


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})))), ' ') AS terms FROM documents")
def trigger_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.trigger_terms(F.col("text")), " ").alias("terms"))


_ENTRIES = ("main.py", "a/cli.py", "mains.py", "run.sh", "x/entrypoint.sh", "index.js", "index.ts", "run.md", "setup.py", "__main__.py")
_IS_ENTRY = (True, True, False, True, True, True, True, False, False, True)


@query(f"SELECT o_orderkey, o_orderstatus IN ('O', 'F') OR [{', '.join(str(x).lower() for x in _IS_ENTRY)}][o_orderkey % {len(_ENTRIES)} + 1] AS entered FROM orders")
def entered_files(spark: SparkSession, d: str) -> DataFrame:
    """Entered are files that are loaded, and those that a language always enters by name."""
    path = F.element_at(F.array(*map(F.lit, _ENTRIES)), (F.col("o_orderkey") % len(_ENTRIES) + 1).cast("int"))
    phase = F.when(F.col("o_orderstatus") == "O", "on_trigger").when(F.col("o_orderstatus") == "F", "reference").otherwise("unreferenced")
    return table(spark, d, "orders").select("o_orderkey", planes.is_entered(phase, path, T.language_of(path)).alias("entered"))


@query(f"WITH {_FILES} SELECT root, path, 'unsupported_language' AS reason FROM files WHERE parsed_as NOT IN ('markdown', 'python', 'shell', 'javascript', 'typescript')")
def unsupported_files(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(x,) for x in ("markdown", *T.CODE)], "parsed_as string")
    return files(spark, d).join(F.broadcast(known), "parsed_as", "left_anti").select("root", "path", F.lit("unsupported_language").alias("reason"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE false END AS exact,
    CASE p_partkey % 6 WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS tail, p_partkey % 6 = 0 AS rooted FROM part""")
def match_modes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    v = F.element_at(F.array(F.concat(F.lit("~/.ssh/"), k), F.concat(k, F.lit("/.netrc")), F.concat(F.lit("a/credentials/"), k), F.concat(F.lit("my-credentials/"), k), F.concat(F.lit("x.netrc"), k), F.concat(F.lit("b/~/.ssh/"), k)), (F.col("p_partkey") % 6 + 1).cast("int"))
    lists = (["~/.ssh/"], [".netrc"], ["credentials"])
    return table(spark, d, "part").select("p_partkey", *(T.matches_lists(F.lit(m), v, *lists).alias(m) for m in ("exact", "tail", "rooted")))


# ---- locks: a bundle is a source and language; the earlier state holds its labelled documents, the later one all.
_TERM = (("fs.read.credential", 'token = "'), ("net.egress", "icense"), ("env.read.secret", "@mail"), ("code.obfuscation", "%%%"), ("process.exec", "!! "), ("code.dynamic_eval", " | "))
_CAPS = "unnest(list_filter([" + ", ".join(f"CASE WHEN contains(text, '{m}') THEN '{t}' END" for t, m in _TERM) + "], lambda x: x IS NOT NULL))"


def _lock_sql(name: str, source: str) -> str:
    return f"""{name}_f AS (SELECT source || '-' || lang AS root, lpad(doc_id::VARCHAR, 8, '0') AS path, sha256(text) AS sha256, text FROM {source}),
{name}_d AS (SELECT root, {_DIGEST} AS content_digest FROM {name}_f GROUP BY root),
{name}_t AS (SELECT DISTINCT root, {_CAPS} AS term FROM {name}_f),
{name} AS (SELECT root, content_digest, coalesce(terms, []) AS terms FROM {name}_d LEFT JOIN (SELECT root, list(term ORDER BY term) AS terms FROM {name}_t GROUP BY root) USING (root))"""


_LOCKS = f"WITH {_lock_sql('a', 'documents')}, {_lock_sql('b', '(SELECT documents.* FROM documents SEMI JOIN labels USING (doc_id))')}"
_DIFF = _LOCKS + """, j AS (SELECT coalesce(a.root, b.root) AS root, b.content_digest AS bd, a.content_digest AS ad, b.terms AS bt, a.terms AS at_ FROM b FULL JOIN a ON a.root = b.root),
c AS (SELECT root, 'bundle_added' AS kind, NULL::VARCHAR AS capability, bd AS before, ad AS after FROM j WHERE bd IS NULL
UNION ALL SELECT root, 'bundle_removed', NULL, bd, ad FROM j WHERE ad IS NULL
UNION ALL SELECT root, 'capability_added', unnest(list_filter(at_, lambda x: NOT list_contains(coalesce(bt, []), x))), bd, ad FROM j WHERE ad IS NOT NULL
UNION ALL SELECT root, 'capability_removed', unnest(list_filter(bt, lambda x: NOT list_contains(at_, x))), bd, ad FROM j WHERE ad IS NOT NULL AND bd IS NOT NULL
UNION ALL SELECT root, 'content_changed', NULL, bd, ad FROM j WHERE bd <> ad)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """A file for each document: hash and terms, so that joins carry no text."""
    terms = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(m)), F.lit(t)) for t, m in _TERM)))
    return table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("-"), "lang").alias("root"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("path"), T.sha256(F.col("text")).alias("sha256"), terms.alias("terms"))


def _caps(facts: DataFrame) -> DataFrame:
    return facts.select("root", F.explode("terms").alias("term")).distinct()


def _lock(facts: DataFrame) -> DataFrame:
    return state.build_lock(state.content_digest(facts, "root"), _caps(facts))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    return state.diff_locks(_lock(f.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")), _lock(f))


@query(_LOCKS + " SELECT root, content_digest, array_to_string(terms, ',') AS capabilities FROM a")
def lock_build(spark: SparkSession, d: str) -> DataFrame:
    return _lock(_facts(spark, d)).withColumn("capabilities", F.array_join("capabilities", ","))


@query(_DIFF + " SELECT * FROM c")
def lock_diff(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d)


@query(_DIFF + " SELECT c.* FROM c WHERE kind = 'capability_added' OR (kind = 'bundle_added' AND root IN (SELECT root FROM c WHERE kind = 'capability_added'))")
def escalations(spark: SparkSession, d: str) -> DataFrame:
    return state.escalations(_changes(spark, d))


_CODE_READ = "SELECT source || '-' || lang AS root, count(*) FILTER (WHERE contains(text, 'token = \"')) AS n FROM documents GROUP BY 1"


@query(_DIFF + f" SELECT c.* FROM c LEFT JOIN ({_CODE_READ}) r USING (root) WHERE kind = 'content_changed' AND coalesce(n, 0) = 0")
def unanalysed_changes(spark: SparkSession, d: str) -> DataFrame:
    read = table(spark, d, "documents").groupBy(F.concat("source", F.lit("-"), "lang").alias("root")).agg(F.count_if(F.contains("text", F.lit('token = "'))).alias("code_files_read"))
    return state.unanalysed(_changes(spark, d), read).select("root", "kind", "capability", "before", "after")


_VIOL = f"""WITH k AS (SELECT DISTINCT source || '-' || lang AS root, {_CAPS} AS term FROM documents) SELECT root, term FROM k
WHERE term NOT IN ('net.egress') AND NOT (term = 'env.read.secret' AND root LIKE '%-en') AND NOT (term = 'process.exec' AND root LIKE 'src1%')"""


def _violations(spark: SparkSession, d: str) -> DataFrame:
    caps = _caps(_facts(spark, d))
    state.check_policy("process.exec net.egress env.read.secret".split())
    roots = caps.select("root").distinct()
    own = roots.where("root like '%-en'").select("root", F.lit("env.read.secret").alias("term")).unionByName(roots.where("root like 'src1%'").select("root", F.lit("process.exec").alias("term")))
    return state.violations(caps, spark.createDataFrame([("net.egress",)], "term string"), own).select("root", "term")


@query(_VIOL)
def policy_violations(spark: SparkSession, d: str) -> DataFrame:
    return _violations(spark, d)


@query(_DIFF + f", e AS (SELECT count(*) > 0 AS x FROM c WHERE kind = 'capability_added'), v AS (SELECT count(*) > 0 AS y FROM ({_VIOL})) SELECT (x::INTEGER + 2 * y::INTEGER) AS exit_code FROM e, v")
def ci_outcome(spark: SparkSession, d: str) -> DataFrame:
    e = state.escalations(_changes(spark, d)).agg((F.count("*") > 0).cast("int").alias("e"))
    v = _violations(spark, d).agg((F.count("*") > 0).cast("int").alias("v"))
    return e.crossJoin(v).select((F.col("e") + 2 * F.col("v")).alias("exit_code"))


# ---- corpus
@query(f"""WITH {_FILES} SELECT root, count(*) AS files, sum(size)::BIGINT AS total_bytes, coalesce(sum(size) FILTER (WHERE load_phase = 'reference'), 0)::BIGINT AS reference_bytes,
    coalesce(sum(size) FILTER (WHERE load_phase = 'unreferenced'), 0)::BIGINT AS unreferenced_bytes, bool_or(load_phase = 'unreferenced') AS has_unreferenced,
    bool_or(parsed_as IN ('python', 'shell', 'javascript', 'typescript', 'ruby', 'rust', 'go')) AS has_scripts, max(l.languages) AS languages, max(octet_length(encode(root)))::BIGINT AS description_bytes
    FROM files JOIN (SELECT root, string_agg(parsed_as || '=' || n, ',' ORDER BY parsed_as) AS languages FROM (SELECT root, parsed_as, count(*) AS n FROM files GROUP BY ALL) GROUP BY root) l USING (root) GROUP BY root""")
def structure_measures(spark: SparkSession, d: str) -> DataFrame:
    """A source's own name stands for its description."""
    f = files(spark, d)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return corpus.structure(f, f.select("root", F.col("root").alias("description")).distinct()).withColumn("languages", text)


def _re(needle: str) -> str:
    import re

    end = "([^A-Za-z0-9]|\\z)" if needle[-1].isalnum() else ""
    return f"regexp_matches(text, '{re.escape(needle)}{end}')".replace("\\ ", " ").replace("\\@", "@").replace("\\!", "!").replace("\\=", "=").replace("\\%", "%").replace("\\/", "/").replace("\\:", ":")


_HIT = {m: "(" + " OR ".join(map(_re, ns)) + ")" for m, ns in O.NEEDLES.items()}
#: Documents with something at their end that is, or only looks like, one of the needles.
_SEEN = f"{_FILES.replace('files AS', 'plain AS')}, files AS (SELECT * REPLACE (text || ' ' || [{O.listed(O.SHOWN)}][doc_id % {len(O.SHOWN)} + 1] AS text) FROM plain)"
_LEX = f"WITH {_SEEN}, lex AS (" + " UNION ALL ".join(f"SELECT root, '{m}' AS marker, bool_or({h}) AS hit, bool_or({h}) AND NOT bool_or({h} AND load_phase <> 'unreferenced') AS only_unreferenced FROM files GROUP BY root" for m, h in _HIT.items()) + ")"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    shown = F.element_at(F.array(*map(F.lit, O.SHOWN)), (F.col("doc_id") % len(O.SHOWN) + 1).cast("int"))
    return files(spark, d).withColumn("text", F.concat("text", F.lit(" "), shown))


@query(_LEX + " SELECT * FROM lex")
def lexical_markers(spark: SparkSession, d: str) -> DataFrame:
    return corpus.lexical(_marked(spark, d))


@query(f"WITH {_SEEN} SELECT doc_id, " + ", ".join(f"{h} AS {m}" for m, h in _HIT.items()) + " FROM files")
def marked_files(spark: SparkSession, d: str) -> DataFrame:
    """Each marker in each text by itself."""
    return corpus.flagged(_marked(spark, d).select("doc_id", "text"))


_PATHS = ("LICENSE", "docs/license.txt", "LICENSES.md", "a/LICENSE.md", "notes.md", "unlicense")
_KEYS = ("name", "description", "version", "license", "schema_version", "metadata", "revision", "allowed-tools")


@query(f"""WITH k AS (SELECT source AS root, bool_or([{O.listed(_PATHS)}][doc_id % 6 + 1] IN ('LICENSE', 'docs/license.txt', 'a/LICENSE.md')) AS has_license, min(doc_id) % 3 > 0 AS ok,
    list_distinct(list([{O.listed(_KEYS)}][n_chars % 8 + 1])) AS keys FROM documents GROUP BY 1)
SELECT root, has_license, ok AND (list_contains(keys, 'version') OR list_contains(keys, 'revision') OR list_contains(keys, 'schema_version')) AS has_version, ok AS frontmatter_parsed,
    CASE WHEN ok THEN array_to_string(list_sort(list_filter(keys, lambda x: x NOT IN ('name', 'description'))), ',') ELSE '' END AS extra_keys FROM k""")
def governance(spark: SparkSession, d: str) -> DataFrame:
    """A source's files have names by their ids; its frontmatter has a key for each length of a text modulo 8, and can't be read in a third of the sources."""
    doc = table(spark, d, "documents")
    f = doc.select(F.col("source").alias("root"), F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("doc_id") % 6 + 1).cast("int")).alias("path"))
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("n_chars") % 8 + 1).cast("int"))
    heads = doc.groupBy(F.col("source").alias("root")).agg((F.min("doc_id") % 3 > 0).alias("ok"), F.collect_set(key).alias("keys"))
    g = corpus.governance(f, heads)
    return g.select("root", "has_license", "has_version", "frontmatter_parsed", F.array_join("extra_frontmatter_keys", ",").alias("extra_keys"))


_PCT = "CASE WHEN {d} = 0 THEN {n} || '/0 (n/a)' ELSE {n} || '/' || {d} || ' (' || ({n} * 1000 // {d}) // 10 || '.' || ({n} * 1000 // {d}) % 10 || '%)' END"


@query("WITH x AS (SELECT source IN ('src0', 'src1', 'src2', 'src3') AS is_head, contains(text, 'token = \"') AS hit FROM documents), g AS (SELECT CASE WHEN grouping(is_head) = 1 THEN 'all' WHEN is_head THEN 'head' ELSE 'tail' END AS part, count(*) FILTER (WHERE hit) AS hits, count(*) AS total FROM x GROUP BY GROUPING SETS ((is_head), ())) SELECT part, hits, total, " + _PCT.format(n="hits", d="total") + " AS rate FROM g")
def head_tail_rates(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.col("source").isin("src0", "src1", "src2", "src3").alias("is_head"), F.contains("text", F.lit('token = "')).alias("hit"))
    g = x.rollup("is_head").agg(F.grouping("is_head").alias("g"), F.count_if("hit").alias("hits"), F.count("*").alias("total"))
    return g.select(F.when(F.col("g") == 1, "all").when(F.col("is_head"), "head").otherwise("tail").alias("part"), "hits", "total", T.percent_text(F.col("hits"), F.col("total")).alias("rate"))


@query("""WITH s AS (SELECT source, (octet_length(encode(split_part(text, chr(10), 1))) * 1000000 // nullif(octet_length(encode(text)), 0))::BIGINT AS ppm FROM documents),
o AS (SELECT source, list(ppm ORDER BY ppm) FILTER (WHERE ppm IS NOT NULL) AS l FROM s GROUP BY source)
SELECT source, CASE WHEN len(l) % 2 = 1 THEN l[len(l) // 2 + 1] ELSE (l[len(l) // 2] + l[len(l) // 2 + 1]) // 2 END AS median_ppm, len(l)::INTEGER AS n FROM o""")
def description_share(spark: SparkSession, d: str) -> DataFrame:
    ppm = T.share_ppm(F.octet_length(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))), F.octet_length("text"))
    s = table(spark, d, "documents").select("source", ppm.alias("ppm"))
    return s.groupBy("source").agg(corpus.middle_ppm(F.col("ppm")).alias("median_ppm"), F.count("ppm").cast("int").alias("n"))


@query("WITH f AS (SELECT lang, count(DISTINCT source) AS bundles FROM documents GROUP BY lang), t AS (SELECT count(DISTINCT source) AS total FROM documents) SELECT lang, bundles, bundles * 100 // total >= 5 AS common FROM f, t")
def language_frequency(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    total = doc.agg(F.count_distinct("source").alias("total"))
    return corpus.frequency(doc, "lang", "source").crossJoin(F.broadcast(total)).select("lang", "bundles", (F.floor(F.col("bundles") * 100 / F.col("total")) >= 5).alias("common"))


@query("SELECT u.key, count(DISTINCT event_type) AS bundles, count(*) AS uses FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) u GROUP BY u.key")
def key_frequency(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return k.groupBy("key").agg(F.count_distinct("event_type").alias("bundles"), F.count("*").alias("uses"))


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT count(*) AS total FROM documents) SELECT source, n, n * 2 > total AS dominates FROM c, t ORDER BY n DESC, source LIMIT 1")
def dominant_source(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return c.agg(F.min_by(F.struct("source", "n"), F.struct(-F.col("n"), "source")).alias("x"), F.sum("n").alias("total")).select("x.source", "x.n", (F.col("x.n") * 2 > F.col("total")).alias("dominates"))


@query(f"SELECT [{O.listed(c for _, c in O.REASONS)}][event_id % {len(O.REASONS)} + 1] AS class, count(*) AS n FROM events GROUP BY 1")
def skip_classes(spark: SparkSession, d: str) -> DataFrame:
    reason = F.element_at(F.array(*(F.lit(r) for r, _ in O.REASONS)), (F.col("event_id") % len(O.REASONS) + 1).cast("int"))
    return table(spark, d, "events").select(T.skip_class(reason).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


_STRATA = f"""WITH {_SEEN}, s AS (SELECT 'sha256:' || sha256 AS digest, doc_id, CASE
    WHEN code AND cred AND load_phase = 'unreferenced' THEN 'disclosure_shape' WHEN code AND cred THEN 'code_credential' WHEN code AND other THEN 'code_other_marker' WHEN code THEN 'code_clean' WHEN NOT cred AND NOT other THEN 'prose_only' END AS stratum
    FROM (SELECT *, parsed_as IN ('python', 'shell', 'javascript', 'typescript') AS code, {_HIT['credential_paths']} AS cred, ({_HIT['secret_env']} OR {_HIT['dynamic_eval']} OR {_HIT['agent_config_write']} OR {_HIT['install_fetch']} OR {_HIT['encoding_chain']}) AS other FROM files))"""


def _strata(spark: SparkSession, d: str) -> DataFrame:
    f = corpus.flagged(_marked(spark, d))
    other = T.any_of([F.col(m) for m in corpus.OTHER_MARKERS])
    return f.select(T.wire(F.col("sha256")).alias("digest"), "doc_id", corpus.stratum(F.col("parsed_as").isin(*T.CODE), F.col("credential_paths"), F.col("load_phase") == "unreferenced", other).alias("stratum"))


@query(_STRATA + " SELECT stratum, count(*) AS population FROM s GROUP BY stratum")
def strata(spark: SparkSession, d: str) -> DataFrame:
    return _strata(spark, d).groupBy("stratum").agg(F.count("*").alias("population"))


@query(_STRATA + f", u AS (SELECT digest, min(doc_id) AS doc_id, min_by(struct_pack(s := stratum), doc_id).s AS stratum FROM s GROUP BY digest), r AS (SELECT digest, stratum, doc_id, row_number() OVER (PARTITION BY stratum ORDER BY sha256('2026-08' || digest), digest)::INTEGER AS position FROM u WHERE stratum IS NOT NULL) SELECT * FROM r WHERE position <= {O.QUOTA}")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    first = corpus.first_of_each(_strata(spark, d), "digest", ["doc_id"])
    return corpus.draw(first, "2026-08", corpus.QUOTAS).select("digest", "stratum", "doc_id", "position")


_Z = 1.959963984540054


def _wilson_sql(h: str, n: str, name: str) -> str:
    p, m = f"({h}::DOUBLE / {n})", f"(1 + {_Z * _Z!r} / {n}::DOUBLE)"
    mid, half = f"(({p} + {_Z * _Z!r} / (2 * {n}::DOUBLE)) / {m})", f"({_Z} * sqrt({p} * (1 - {p}) / {n}::DOUBLE + {_Z * _Z!r} / (4 * {n}::DOUBLE * {n}::DOUBLE)) / {m})"
    return f"CASE WHEN {n} > 0 THEN round({p}, 9) END AS {name}, CASE WHEN {n} = 0 THEN 0.0 ELSE round(greatest({mid} - {half}, 0.0), 9) END AS {name}_low, CASE WHEN {n} = 0 THEN 1.0 ELSE round(least({mid} + {half}, 1.0), 9) END AS {name}_high"


#: Scored terms: what a marker predicts, and the label it should agree with.
_SCORED = (("low_quality.symbols", "%%%", "quality = 0"), ("low_quality.caps", "!! ", "quality = 0"), ("low_quality.menu", " | ", "quality = 0"), ("toxic.plain", "scum", "toxic = 1"), ("nothing", "never there", "toxic = 1"))
_CELLS = "WITH cells AS (" + " UNION ALL ".join(f"SELECT '{t}' AS term, contains(text, '{m}') AS predicted, {l} AS actual FROM documents JOIN labels USING (doc_id)" for t, m, l in _SCORED) + "), k AS (SELECT term, count(*) FILTER (WHERE predicted AND actual) AS tp, count(*) FILTER (WHERE predicted AND NOT actual) AS fp, count(*) FILTER (WHERE NOT predicted AND actual) AS fn, count(*) FILTER (WHERE NOT predicted AND NOT actual) AS tn FROM cells GROUP BY term)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "documents").select("doc_id", "lang", F.array(*(F.contains("text", F.lit(m)) for _, m, _ in _SCORED)).alias("hits"))
    x = flags.join(table(spark, d, "labels"), "doc_id")
    rows = F.array(*(F.struct(F.lit(t).alias("term"), F.col("hits")[k].alias("predicted"), F.expr(label).alias("actual")) for k, (t, _, label) in enumerate(_SCORED)))
    return x.select("doc_id", "lang", F.explode(rows).alias("c")).select("doc_id", "lang", "c.*")


@query(_CELLS + f" SELECT term, tp, fp, fn, tn, {_wilson_sql('tp', '(tp + fp)', 'precision')}, {_wilson_sql('tp', '(tp + fn)', 'recall')} FROM k")
def term_scores(spark: SparkSession, d: str) -> DataFrame:
    return corpus.confusion(_cells(spark, d))


@query("SELECT '{t}' AS term, count(DISTINCT doc_id) AS bundles FROM documents JOIN labels USING (doc_id) WHERE contains(text, '{m}')".format(t="network.mail", m="@mail") + " HAVING count(*) > 0 UNION ALL SELECT 'license.text', count(DISTINCT doc_id) FROM documents JOIN labels USING (doc_id) WHERE contains(text, 'icense') HAVING count(*) > 0")
def unmeasured_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(m)), F.lit(t)) for t, m in (("network.mail", "@mail"), ("license.text", "icense")))))
    found = table(spark, d, "documents").select("doc_id", F.explode(terms).alias("term"))
    return found.join(table(spark, d, "labels").select("doc_id"), "doc_id").groupBy("term").agg(F.count_distinct("doc_id").alias("bundles"))


_RATES = """WITH p AS (SELECT lang AS stratum, count(*) AS population FROM documents GROUP BY 1), r AS (SELECT lang AS stratum, count(*) AS total, count(*) FILTER (WHERE quality = 0) AS hits, count(*) FILTER (WHERE toxic = 1) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1)"""


def _rates(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    p = doc.groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("population"))
    r = doc.join(table(spark, d, "labels"), "doc_id").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 0).alias("hits"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return p.join(r, "stratum")


@query(_RATES + " SELECT stratum, population, total, hits, toxic, (population * 1000000 // sum(population) OVER ())::BIGINT AS share_ppm FROM p JOIN r USING (stratum)")
def stratum_rates(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return _rates(spark, d).withColumn("share_ppm", T.share_ppm(F.col("population"), F.sum("population").over(Window.partitionBy())))


@query(_RATES + f", w AS (SELECT population / sum(population) OVER () AS w, hits / total AS p, total FROM p JOIN r USING (stratum)), e AS (SELECT sum(w * p) AS e, sum(w * w * p * (1 - p) / total) AS v, min(total) AS least FROM w) SELECT CASE WHEN least >= 5 THEN round(e, 9) END AS estimate, CASE WHEN least >= 5 THEN round(greatest(e - {_Z} * sqrt(v), 0.0), 9) END AS low, CASE WHEN least >= 5 THEN round(least(e + {_Z} * sqrt(v), 1.0), 9) END AS high FROM e")
def stratified_estimate(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stratified(_rates(spark, d))


@query(_CELLS.replace("AS actual FROM documents JOIN labels USING (doc_id)", "AS actual FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr')") + " SELECT term, tp, fp, fn, tn FROM k")
def signal_scores(spark: SparkSession, d: str) -> DataFrame:
    named = spark.createDataFrame([("en",), ("fr",)], "lang string")
    return corpus.confusion(_cells(spark, d).join(F.broadcast(named), "lang", "left_semi")).select("term", "tp", "fp", "fn", "tn")
