"""Suites against their baseline, and expectations against what was found."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.functions import text as T
from capledger.functions.vocabulary import VERDICTS
from capledger.operators import planes, state

ASSERTIONS = ("capability", "escalation", "instruction", "load_phase", "no_capability", "no_instruction", "no_verdict", "unresolved")
#: What a case may need before it can run; a case that needs what isn't there is pending, not failed.
REQUIREMENTS = ("available", "corpus", "model", "rule", "task")


def verdict_words(document: Column) -> Column:
    """The words of a JSON document that would be a verdict."""
    low = F.lower(document)
    return F.filter(F.array(*map(F.lit, VERDICTS)), lambda w: F.contains(low, w))


def has_fraction(document: Column) -> Column:
    """Whether a JSON document has a number with a point or an exponent. Strings are taken out first: a version in one is no number."""
    return F.regexp_replace(document, r'"(?:[^"\\]|\\.)*+"', "0").rlike(r"[0-9][.eE]")


def verdict_free(document: Column) -> Column:
    """Whether a JSON document holds no verdict and no fractional number, a score in disguise."""
    return (F.size(verdict_words(document)) == 0) & ~has_fraction(document)


def check_expectations(rows: DataFrame) -> DataFrame:
    """rows as they are; kinds of assertion that aren't known, and those without what they assert, are an error at run time."""
    needs = {"capability": "capability", "escalation": "capability", "instruction": "signal", "load_phase": "path", "unresolved": "reason"}
    whole = T.any_of([(F.col("kind") == k) & F.col(c).isNotNull() for k, c in needs.items()]) | F.col("kind").isin("no_capability", "no_instruction", "no_verdict")
    return rows.where(F.when(F.coalesce(whole, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("an expectation that says nothing: "), F.coalesce("kind", F.lit("null")), F.lit(" in "), F.coalesce("case", F.lit("null")))).cast("boolean")))


def hold(expectations: DataFrame, files: DataFrame, capabilities: DataFrame, instructions: DataFrame, unresolved: DataFrame, manifests: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """(case, kind, about, ok): every expectation held against the planes of its bundle, by one equality join: each kind asks one plane for one key, so planes are put below one another.

    expectations: case, root, kind, capability, reachability, reason, path, phase, signal (null where a kind doesn't use it).
    A capability may say how far it has to reach; ``escalation`` looks in changes (root, kind, capability) against an earlier lock, and fails without
    one; the negative kinds hold for bundles that nothing was found in; ``no_verdict`` reads manifests (root, json).
    """

    def plane(rows: DataFrame, kind: str, key: str | None = None, got: Column | None = None) -> DataFrame:
        return rows.select("root", F.lit(kind).alias("kind"), (F.col(key) if key else F.lit("")).alias("key"), (F.lit("") if got is None else got).alias("got"))

    said = [
        plane(capabilities, "capability", "term", F.coalesce("reachability", F.lit(""))),
        plane(unresolved.select("root", "reason").distinct(), "unresolved", "reason"),
        plane(files, "load_phase", "path", F.coalesce("load_phase", F.lit(""))),
        plane(instructions, "instruction", "signal"),
        plane(capabilities.select("root").distinct(), "no_capability"),
        plane(instructions.select("root").distinct(), "no_instruction"),
    ]
    if changes is not None:
        gained = changes.where("kind = 'capability_added'").select("root", "capability").distinct()
        # What a bundle that wasn't there before brings is no escalation of an update to it.
        said.append(plane(gained.join(changes.where("kind = 'bundle_added'").select("root"), "root", "left_anti"), "escalation", "capability"))
    if manifests is not None:
        said.append(plane(manifests, "no_verdict", None, F.when(verdict_free(F.col("json")), "free").otherwise("")))
    kind, want, got = F.col("kind"), F.col("want"), F.col("got")
    key = F.when(kind.isin("capability", "escalation"), F.col("capability")).when(kind == "instruction", F.col("signal")).when(kind == "load_phase", F.col("path")).when(kind == "unresolved", F.col("reason")).otherwise("")
    wanted = F.when(kind == "capability", F.col("reachability")).when(kind == "load_phase", F.col("phase")).when(kind == "no_verdict", "free")
    about = F.coalesce("capability", "signal", "reason", "path", F.lit(""))
    e = check_expectations(expectations).select("case", "root", "kind", about.alias("about"), key.alias("key"), wanted.alias("want"))
    e = e.join(reduce(DataFrame.unionByName, said), ["root", "kind", "key"], "left")
    ok = F.when(kind.isin("no_capability", "no_instruction"), got.isNull()).when(kind.isin("load_phase", "no_verdict"), got == want).otherwise(got.isNotNull() & (want.isNull() | (got == want)))
    return e.select("case", "kind", "about", F.coalesce(ok, F.lit(False)).alias("ok"))


def outcomes(cases: DataFrame, held: DataFrame, suite: str) -> DataFrame:
    """(suite, case, outcome): failed where any expectation fails, or a case has none; pending where what it requires isn't available. cases: case, requires."""
    h = held.groupBy("case").agg(F.bool_and("ok").alias("ok"))
    j = cases.join(h, "case", "left")
    outcome = F.when(F.coalesce("requires", F.lit("available")) != "available", "pending").when(F.coalesce("ok", F.lit(False)), "passed").otherwise("failed")
    return j.select(F.lit(suite).alias("suite"), "case", outcome.alias("outcome"))


def fires(fixtures: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """(fixture, fires): whether any plane finds anything, or meets what it can't tell, in one file taken by itself and as entered. fixtures: fixture, path, language, text."""
    f = fixtures.select(F.col("fixture").cast("string").alias("root"), "path", "language", F.lit(True).alias("entered"), "text")
    found = planes.findings(planes.events(f), rules).select("root").distinct().withColumn("hit", F.lit(True))
    return f.select("root").join(found, "root", "left").select(F.col("root").alias("fixture"), F.coalesce("hit", F.lit(False)).alias("fires"))


def fixture_outcomes(fixtures: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """(suite, case, outcome): a positive fixture has to fire, a negative one to be silent against all rules. fixtures: fixture, polarity, path, language, text."""
    j = fixtures.select(F.col("fixture").cast("string").alias("fixture"), "polarity").join(fires(fixtures, rules), "fixture")
    return j.select(F.lit("fixtures").alias("suite"), F.col("fixture").alias("case"), F.when(F.col("fires") == (F.col("polarity") == "positive"), "passed").otherwise("failed").alias("outcome"))


def metrics(results: DataFrame) -> DataFrame:
    """(suite, passed, failed, pending). results: suite, case, outcome."""
    return results.groupBy("suite").agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("passed", "failed", "pending")))


def fewer(baseline: DataFrame, now: DataFrame) -> DataFrame:
    """(suite, passed, failed, pending, regressed): a suite regresses if it has failures or runs fewer cases than its baseline. baseline: suite, cases; now: results."""
    m = metrics(now).join(baseline.select("suite", "cases"), "suite", "left")
    return m.select("suite", "passed", "failed", "pending", ((F.col("failed") > 0) | (F.col("passed") + F.col("failed") < F.coalesce("cases", F.lit(0)))).alias("regressed"))


def regressions(baseline: DataFrame, now: DataFrame) -> DataFrame:
    """(suite, case, why): cases that fail, that were run before and aren't any more, and that are newly pending. Both: suite, case, outcome."""
    b = baseline.select("suite", "case", F.col("outcome").alias("was"))
    n = now.select("suite", "case", F.col("outcome").alias("is_"))
    j = b.join(n, ["suite", "case"], "full_outer")
    why = F.when(F.col("is_") == "failed", "failed").when(F.col("is_").isNull() & (F.col("was") != "pending"), "no longer run").when((F.col("is_") == "pending") & (F.coalesce("was", F.lit("")) != "pending"), "newly pending")
    return j.select("suite", "case", why.alias("why")).where("why is not null")


def baseline_json(results: DataFrame, note: str) -> str:
    """What a blessed run is remembered by."""
    rows = {r["suite"]: {"failed": r["failed"], "passed": r["passed"], "pending": r["pending"]} for r in metrics(results).toLocalIterator()}
    return json.dumps({"metrics": rows, "note": note}, sort_keys=True, indent=2) + "\n"


def read_baseline(text: str) -> dict[str, int]:
    """Cases that each suite of a baseline ran; unknown keys are an error."""
    x = json.loads(text)
    if extra := set(x) - {"corpus_snapshot", "metrics", "note"}:
        raise ValueError(f"unknown key in the baseline: {sorted(extra)}")
    return {suite: m["passed"] + m["failed"] for suite, m in x["metrics"].items()}


def bless(path: str, results: DataFrame, note: str) -> str:
    """Write the baseline of a run without failures, with a note on why it is the new one; one with failures, or without a note, is refused."""
    if not note.strip():
        raise ValueError("a baseline needs a note")
    if bad := [r["suite"] for r in metrics(results).where("failed > 0").toLocalIterator()]:
        raise ValueError(f"failures can't be blessed: {bad}")
    text = baseline_json(results, note)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text


def escalated(before: DataFrame, now: DataFrame) -> DataFrame:
    """Changes of two locks for the ``escalation`` assertion."""
    return state.diff_locks(before, now)
