"""Files to events, events to capabilities and instructions. Rules are data: a predicate over event columns, with path lists."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.functions import text as T
from capledger.functions.extract import FIELDS, extract
from capledger.operators.state import TERMS
from capledger.sources.tables import read_toml

SIGNALS = tuple("instruction.config_mutation instruction.directs_outside_write instruction.exec_directive instruction.fetch_as_instruction".split())
READ = ("markdown", *T.CODE)
KEPT = "reach start_byte end_byte start_line snippet_sha256".split()
EVENT = "root string, path string, language string, kind string, recv string, callee string, shape string, inner array<string>, info string, target_kind string, target string, start_byte long, end_byte long, start_line long, reach string, snippet_sha256 string, text string"


def load_rules(path: str | None = None) -> list[dict]:
    """The shipped rules or those of a file; unknown keys, terms and languages, missing parts and repeated ids are errors, and so is having none."""
    if path is None:
        import importlib.resources

        import tomllib

        rules = tomllib.loads(importlib.resources.files("capledger.sources").joinpath("rules.toml").read_text("utf-8"))["rule"]
    else:
        rules = read_toml(os.fspath(path)).get("rule", [])
    if not rules:
        raise ValueError("no rules")
    seen = set()
    for r in rules:
        if extra := set(r) - {"id", "languages", "term", "where", "summary", "prefixes", "suffixes", "contains"}:
            raise ValueError(f"unknown key in a rule: {sorted(extra)}")
        if missing := {"id", "languages", "term", "where", "summary"} - set(r):
            raise ValueError(f"a rule lacks {sorted(missing)}")
        if r["term"] not in TERMS + SIGNALS:
            raise ValueError(f"unknown term {r['term']}")
        if unknown := set(r["languages"]) - set(READ):
            raise ValueError(f"unknown language {sorted(unknown)}")
        if (r["term"] in SIGNALS) != (r["languages"] == ["markdown"]):
            raise ValueError(f"{r['id']}: signals are for prose, capabilities for code")
        if r["id"] in seen:
            raise ValueError(f"repeated rule {r['id']}")
        seen.add(r["id"])
    return sorted(rules, key=lambda r: r["id"])


def load_languages(path: str | None = None) -> dict[str, dict]:
    """Languages with their extensions and the names of entry points; unknown keys, and one extension of two languages, are errors."""
    if path is None:
        import importlib.resources

        import tomllib

        table = tomllib.loads(importlib.resources.files("capledger.sources").joinpath("languages.toml").read_text("utf-8"))
    else:
        table = read_toml(path)
    seen: set[str] = set()
    for name, x in table.items():
        if extra := set(x) - {"extensions", "entry_basenames"}:
            raise ValueError(f"unknown key of {name}: {sorted(extra)}")
        if both := seen & set(x["extensions"]):
            raise ValueError(f"extensions of two languages: {sorted(both)}")
        seen |= set(x["extensions"])
    return table


def is_entered(phase: Column, path: Column, language: Column, languages: dict[str, dict] | None = None) -> Column:
    """Files that are loaded, and those that their language enters by name wherever they lie."""
    named = T.any_of([(language == name) & T.basename(path).isin(*x["entry_basenames"]) for name, x in (load_languages() if languages is None else languages).items() if x.get("entry_basenames")])
    return phase.isin("on_trigger", "reference") | F.coalesce(named, F.lit(False))


def events(files: DataFrame) -> DataFrame:
    """One pass over each text, whatever the number of rules. files: root, path, language, entered, text."""
    src = files.where(F.col("text").isNotNull() & F.col("language").isin(*READ)).select("root", "path", "language", "entered", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("root", pa.string()), ("path", pa.string()), ("language", pa.string()), ("kind", pa.string()), ("recv", pa.string()), ("callee", pa.string()), ("shape", pa.string()), ("inner", pa.list_(pa.string())), ("info", pa.string()), ("target_kind", pa.string()), ("target", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("start_line", pa.int64()), ("reach", pa.string()), ("snippet_sha256", pa.string()), ("text", pa.string())])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in it:
            rows = []
            for root, path, language, entered, text in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(root, path, language, *e) for e in extract(language, text, bool(entered))]
                while len(rows) >= 5000:
                    yield batch(rows[:5000])
                    rows = rows[5000:]
            if rows:
                yield batch(rows)

    assert len(FIELDS) + 3 == len(EVENT.split(", "))
    return src.mapInArrow(run, EVENT)


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(prefixes: list[str], suffixes: list[str], inner: list[str]) -> str:
    """``text.matches_lists`` as SQL: said so, forty rules are one call to the planner and not thousands."""
    starts = " OR ".join(f"startswith(target, {_q(p)})" for p in prefixes) or "false"
    ends = " OR ".join(f"(target = {_q(p)} OR endswith(target, {_q('/' + p)}))" for p in suffixes) or "false"
    bare = "'/' || regexp_replace(target, '^/+|/+$', '') || '/'"
    holds = " OR ".join(f"contains({bare}, {_q('/' + p.strip('/') + '/')})" for p in inner if p.strip("/")) or "false"
    return f"CASE target_kind WHEN 'exact' THEN ({starts}) OR ({ends}) OR ({holds}) WHEN 'tail' THEN ({ends}) OR ({holds}) WHEN 'rooted' THEN ({starts}) ELSE false END"


def _test(r: dict) -> str:
    lists = [r.get(k, []) for k in ("prefixes", "suffixes", "contains")]
    outcome, value = "'hit'", "CAST(NULL AS STRING)"
    if any(lists):
        also = " WHEN target_kind = 'tail' THEN 'computed'" if lists[0] else ""
        outcome = f"CASE WHEN {_listed(*lists)} THEN 'hit' WHEN coalesce(target_kind, 'unknown') = 'unknown' THEN 'computed'{also} END"
        value = f"CASE WHEN ({outcome}) = 'hit' THEN CASE target_kind WHEN 'tail' THEN '<computed>/' || target WHEN 'rooted' THEN target || '/<computed>' ELSE target END END"
    fires = f"coalesce(({r['where']}), false) AND ({outcome}) IS NOT NULL"
    return f"CASE WHEN {fires} THEN named_struct('rule_id', {_q(r['id'])}, 'term', {_q(r['term'])}, 'outcome', {outcome}, 'value', {value}) END"


def findings(ev: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """(root, path, rule_id, term, outcome, reach, value, span columns). The outcome is ``hit``; ``computed`` where a rule with lists met a target that can't be told; ``broken``, without rule or term, where a file can't be parsed."""
    rules = load_rules() if rules is None else rules
    broken = "CASE WHEN kind = 'parse_error' THEN named_struct('rule_id', '', 'term', '', 'outcome', 'broken', 'value', info) END"
    # An event is held against its language's rules alone.
    of = {lang: [broken, *(_test(r) for r in rules if lang in r["languages"])] for lang in READ}
    tests = " ".join(f"WHEN {_q(lang)} THEN array({', '.join(x)})" for lang, x in of.items())
    tests = F.expr(f"explode(array_compact(CASE language {tests} ELSE array({broken}) END))")
    return ev.select("root", "path", *KEPT, tests.alias("f")).select("root", "path", "f.*", *KEPT)


def _evidence() -> list:
    span = "start_byte end_byte start_line rule_id".split()
    return [F.col("path").alias("file"), *span, T.wire(F.col("snippet_sha256")).alias("snippet_sha256")]


def capabilities(found: DataFrame) -> DataFrame:
    """(root, term, reachability, paths, evidence): the strongest reach of each term, paths distinct and sorted, evidence in order."""
    rank = F.when(F.col("reach") == "observed", 2).when(F.col("reach") == "unresolved", 1).otherwise(0)
    g = found.where((F.col("outcome") == "hit") & ~F.col("term").isin(*SIGNALS)).groupBy("root", "term").agg(F.max(rank).alias("r"), F.sort_array(F.collect_set("value")).alias("paths"), F.sort_array(F.collect_set(F.struct(*_evidence()))).alias("evidence"))
    return g.select("root", "term", F.element_at(F.array(F.lit("present"), F.lit("unresolved"), F.lit("observed")), F.col("r") + 1).alias("reachability"), F.when(F.size("paths") > 0, F.col("paths")).alias("paths"), "evidence")


def instructions(found: DataFrame) -> DataFrame:
    """(root, signal, evidence); never joined with capabilities."""
    return found.where((F.col("outcome") == "hit") & F.col("term").isin(*SIGNALS)).groupBy("root", F.col("term").alias("signal")).agg(F.sort_array(F.collect_set(F.struct(*_evidence()))).alias("evidence"))


def unresolved(found: DataFrame, files: DataFrame) -> DataFrame:
    """(root, reason, file, start_byte, end_byte, start_line, note): what could not be told, so that it isn't taken for nothing."""
    computed = found.where("outcome = 'computed'").select("root", F.lit("computed_target").alias("reason"), F.col("path").alias("file"), "start_byte", "end_byte", "start_line", F.col("rule_id").alias("note"))
    none = F.lit(None).cast("long")
    broken = found.where("outcome = 'broken'").select("root", F.lit("parse_error").alias("reason"), F.col("path").alias("file"), none.alias("start_byte"), none.alias("end_byte"), "start_line", F.col("value").alias("note"))
    other = files.where(F.col("text").isNotNull() & ~F.col("language").isin(*READ)).select("root", F.lit("unsupported_language").alias("reason"), F.col("path").alias("file"), none.alias("start_byte"), none.alias("end_byte"), none.alias("start_line"), F.col("language").alias("note"))
    return computed.unionByName(broken).unionByName(other)
