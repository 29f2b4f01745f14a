"""The engine's verbs over a table of bundle files: scan, lock, check, rules, and the corpus side."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.functions import text as T
from capledger.functions.frontmatter import frontmatter
from capledger.operators import corpus, graph, manifest, planes, state
from capledger.sources.tables import inventory, kept, read_toml, scratch, walked


@dataclass
class Scan:
    """The planes of all bundles, as tables. Only ``texts`` and ``marks`` are computed from texts when they are read; no text is in an exchange."""

    files: DataFrame
    bundles: DataFrame
    heads: DataFrame
    capabilities: DataFrame
    instructions: DataFrame
    unresolved: DataFrame
    texts: DataFrame

    def manifests(self) -> DataFrame:
        return manifest.manifests(self.bundles, self.files, self.capabilities, self.instructions, self.unresolved)

    def lock(self) -> DataFrame:
        return state.build_lock(state.content_digest(self.files, "root"), self.capabilities)

    def marks(self) -> DataFrame:
        """Each file with its phase and a column for each lexical marker."""
        flags = corpus.flagged(self.texts.select("root", "path", "text"))
        return self.files.join(flags, ["root", "path"], "left").fillna(False, list(corpus.MARKERS))


@dataclass
class Check:
    changes: DataFrame
    escalations: DataFrame
    violations: DataFrame
    exit_code: int


def rules() -> list[tuple[str, str, str]]:
    """(id, languages, term) of every rule."""
    return [(r["id"], ",".join(r["languages"]), r["term"]) for r in planes.load_rules()]


def scan(content: DataFrame, rule_file: str | None = None, strict_entry_case: bool = False, problems: DataFrame | None = None) -> Scan:
    """content: root, path, content; problems: root, reason, file, note of what a walk could not give. The entry document is ``SKILL.md`` in any case, the first by name where there are several."""
    spark = content.sparkSession
    inv = inventory(content)
    facts = kept(inv.drop("text"), scratch(spark, "inventory"))
    texts = inv.where("reason is null").select("root", "path", F.col("parsed_as").alias("language"), "text")
    is_entry = (F.col("path") == "SKILL.md") if strict_entry_case else (F.lower("path") == "skill.md")
    entry = facts.where(is_entry & F.col("reason").isNull()).groupBy("root").agg(F.min("path").alias("path"))
    phases = kept(graph.load_phases(facts, entry, graph.mentions(texts, facts)), scratch(spark, "phases"))
    files = facts.join(phases, ["root", "path"])
    # Heads are read from every document that may be the entry; what is joined then are their facts.
    named = texts.where(is_entry).select(F.to_json(F.struct("root", "path")).alias("root"), "text")
    at = F.from_json("root", "root string, path string")
    head = frontmatter(named).withColumn("at", at).withColumns({"root": F.col("at.root"), "path": F.col("at.path")}).drop("at").join(entry, ["root", "path"], "left_semi")
    ev = planes.events(texts.withColumn("entered", F.lit(True))).join(phases.select("root", "path", "load_phase"), ["root", "path"])
    ev = ev.withColumn("is_entered", planes.is_entered(F.col("load_phase"), F.col("path"), F.col("language"))).drop("load_phase")
    # What isn't entered is never more than present.
    ev = ev.withColumn("reach", F.when(F.col("is_entered") | ~F.col("language").isin(*T.CODE), F.col("reach")).when(F.col("reach").isNotNull(), "present")).drop("is_entered")
    # Texts are gone through once, whatever is asked of what was found.
    found = kept(planes.findings(ev, planes.load_rules(rule_file)), scratch(spark, "findings"))
    head = kept(head, scratch(spark, "heads"))
    none = F.lit(None).cast("long")
    spans = [none.alias("start_byte"), none.alias("end_byte")]
    bad_head = head.where("not ok").select("root", F.lit("parse_error").alias("reason"), F.col("path").alias("file"), *spans, F.col("line").alias("start_line"), F.col("message").alias("note"))
    said = F.when(F.col("reason") == "size_limit", "too large; hashed, but not read").when(F.col("reason") == "binary_file", "holds a NUL; not read as text").otherwise("no valid UTF-8; hashed, but not read as text")
    unread = facts.where("reason is not null").select("root", "reason", F.col("path").alias("file"), *spans, none.alias("start_line"), said.alias("note"))
    read = facts.select("root", "path", F.col("parsed_as").alias("language"), F.when(F.col("reason").isNull(), "").alias("text"))
    open_ = planes.unresolved(found, read).unionByName(bad_head).unionByName(unread)
    if problems is not None:
        open_ = open_.unionByName(problems.select("root", "reason", "file", *spans, none.alias("start_line"), "note"))
    bundles = state.content_digest(files, "root").join(head.select("root", "description", "declared"), "root", "left").withColumn("description", F.coalesce("description", F.lit("")))
    return Scan(files, bundles, head, planes.capabilities(found), planes.instructions(found), open_, texts)


def scan_folder(spark: SparkSession, folder: str, direct: bool = False, **kw) -> Scan:
    """A scan of a mounted folder of bundles, or (direct) of one bundle's folder, links followed as far as they stay inside."""
    content, problems = walked(spark, folder, direct)
    return scan(content, problems=problems, **kw)


def load_policy(path: str | None, spark: SparkSession) -> tuple[DataFrame | None, DataFrame | None]:
    """(allowed terms, allowed terms of bundles); an absent file is no policy, an empty one permits nothing. Unknown keys and terms are errors."""
    if path is None:
        return None, None
    p = read_toml(path)
    if extra := set(p) - {"allow", "bundle", "review"}:
        raise ValueError(f"unknown key in the policy: {sorted(extra)}")
    everywhere = p.get("allow", {}).get("capabilities", [])
    own = [(root, t) for root, b in p.get("bundle", {}).items() for t in b.get("allow", {}).get("capabilities", b.get("capabilities", []))]
    state.check_policy([*everywhere, *(t for _, t in own)])
    return spark.createDataFrame([(t,) for t in everywhere], "term string"), spark.createDataFrame(own, "root string, term string")


def check(now: Scan, lock: DataFrame, allow: DataFrame | None = None, allow_bundle: DataFrame | None = None) -> Check:
    """Hold a scan against a lock and a policy."""
    changes = state.diff_locks(lock, now.lock())
    gained = state.escalations(changes)
    broken = state.violations(now.capabilities, allow, allow_bundle).withColumn("first", F.col("evidence")[0])
    return Check(state.ordered(changes), gained, broken, state.decide(not gained.isEmpty(), not broken.isEmpty()))


def write_lock(lock: DataFrame) -> str:
    """The lock as JSON, a map by root."""
    rows = {r["root"]: {"capabilities": list(r["capabilities"]), "content_digest": "sha256:" + r["content_digest"], "schema_version": manifest.SCHEMA_VERSION} for r in lock.toLocalIterator()}
    return json.dumps({"bundles": rows}, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def read_lock(spark: SparkSession, text: str) -> DataFrame:
    x = json.loads(text)["bundles"]
    return spark.createDataFrame([(k, v["content_digest"].removeprefix("sha256:"), v["capabilities"]) for k, v in x.items()], "root string, content_digest string, capabilities array<string>")


def report(changes: DataFrame) -> str:
    """Changes in words, in their order."""
    say = {"bundle_added": "new bundle", "bundle_removed": "bundle is gone", "capability_added": "gained", "capability_removed": "lost", "content_changed": "content changed"}
    return "".join(f"{r['root']}: {say[r['kind']]}{' ' + r['capability'] if r['capability'] else ''}\n" for r in state.ordered(changes).toLocalIterator())


def measure(s: Scan) -> DataFrame:
    """Structure of every bundle."""
    return corpus.structure(s.files, s.bundles, s.unresolved)


def strata(s: Scan) -> DataFrame:
    """(root, digest, stratum) of every bundle."""
    lex = corpus.lexical(s.marks())
    wide = lex.groupBy("root").agg(*(F.bool_or((F.col("marker") == m) & F.col("hit")).alias(m) for m in corpus.MARKERS), F.bool_or((F.col("marker") == "credential_paths") & F.col("only_unreferenced")).alias("hidden"))
    code = s.files.groupBy("root").agg(F.bool_or(F.col("parsed_as").isin(*T.CODE)).alias("has_code"))
    x = code.join(wide, "root").join(s.bundles.select("root", "content_digest"), "root")
    other = T.any_of([F.col(m) for m in corpus.OTHER_MARKERS])
    return x.select("root", T.wire(F.col("content_digest")).alias("digest"), corpus.stratum(F.col("has_code"), F.col("credential_paths"), F.col("hidden"), other).alias("stratum"))


def sample(s: Scan, seed: str) -> DataFrame:
    """A seeded stratified sample of bundles."""
    return corpus.draw(strata(s), seed, corpus.QUOTAS)


def sample_json(s: Scan, snapshot: str, seed: str) -> str:
    """The sample as JSON: how many bundles each stratum has, and which were taken."""
    n = {r["stratum"]: r["n"] for r in strata(s).where("stratum is not null").groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    rows = [{"bundle_root": r["root"], "digest": r["digest"], "stratum": r["stratum"]} for r in sample(s, seed).orderBy("stratum", "position").collect()]
    return json.dumps({"population": n, "seed": seed, "selected": rows, "snapshot": snapshot}, sort_keys=True, indent=2) + "\n"


def index(s: Scan) -> DataFrame:
    """(digest, bundle_root, json): an index record of each bundle, its measures nested, keys sorted."""
    lex = corpus.lexical(s.marks())
    flat = lex.groupBy("root").agg(*(F.bool_or((F.col("marker") == m) & F.col("hit")).alias(m) for m in corpus.MARKERS), F.array_sort(F.collect_set(F.when(F.col("only_unreferenced"), F.col("marker")))).alias("only_in_unreferenced"))
    lexical = flat.select("root", F.struct(*sorted([*corpus.MARKERS, "only_in_unreferenced"])).alias("lexical"))
    st = measure(s)
    structure = st.select("root", F.struct(*sorted(c for c in st.columns if c != "root")).alias("structure"))
    g = corpus.governance(s.files, s.heads)
    governance = g.select("root", F.struct(*sorted(c for c in g.columns if c != "root")).alias("governance"))
    x = structure.join(lexical, "root").join(governance, "root").join(s.bundles.select("root", T.wire(F.col("content_digest")).alias("digest")), "root")
    doc = F.struct(F.col("root").alias("bundle_root"), "digest", F.struct("governance", "lexical", "structure").alias("measurements"))
    return x.select("digest", F.col("root").alias("bundle_root"), F.to_json(doc).alias("json"))


def index_json(s: Scan, snapshot: str) -> str:
    """The whole index as one document."""
    rows = [json.loads(r["json"]) for r in index(s).orderBy("digest", "bundle_root").toLocalIterator()]
    return json.dumps({"records": rows, "snapshot": snapshot}, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def read_index(spark: SparkSession, text: str) -> DataFrame:
    """(digest, bundle_root, json) out of an index, for reports without the bundles themselves."""
    rows = [(r["digest"], r["bundle_root"], json.dumps(r, sort_keys=True)) for r in json.loads(text)["records"]]
    return spark.createDataFrame(rows, "digest string, bundle_root string, json string")


def read_manifests(spark: SparkSession, text: str) -> DataFrame:
    """(root, json) out of a file of manifests, an array or a single one; one without its keys is an error."""
    x = json.loads(text)
    rows = x if isinstance(x, list) else [x]
    for m in rows:
        if missing := {"capabilities", "disclosure", "instructions", "inventory", "schema_version", "target", "unresolved"} - set(m):
            raise ValueError(f"a manifest lacks {sorted(missing)}")
    return spark.createDataFrame([(m["target"]["root"], json.dumps(m, sort_keys=True, ensure_ascii=False)) for m in rows], "root string, json string")
