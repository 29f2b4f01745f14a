"""The suites: folders of rule examples and of adversarial cases, run as tables and held against a baseline."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.operators import gates, planes, state
from capledger.plans import engine
from capledger.sources.tables import kept, read_toml, scratch, walk

_FIXTURE = "fixture string, polarity string, path string, language string, text string"
_EXPECT = "case string, root string, kind string, capability string, reachability string, reason string, path string, phase string, signal string"
_FIELDS = ("capability", "reachability", "reason", "path", "phase", "signal")


def fixtures(spark: SparkSession, folder: str, rule_file: str | None = None) -> DataFrame:
    """``(suite, case, outcome)`` of ``folder/<language>/<rule>/positive.*`` and ``negative.*``; other folders' names are no languages and are passed over."""
    rows = []
    for language in sorted(planes.load_languages()):
        at = os.path.join(folder, language)
        for rule in sorted(os.listdir(at)) if os.path.isdir(at) else ():
            for name in sorted(os.listdir(os.path.join(at, rule))):
                polarity = name.rpartition(".")[0]
                if polarity in ("positive", "negative") and not name.endswith((".json", ".toml")):
                    with open(os.path.join(at, rule, name), encoding="utf-8") as f:
                        rows.append((f"{language}/{rule}/{polarity}", polarity, name, language, f.read()))
    return gates.fixture_outcomes(spark.createDataFrame(rows, _FIXTURE), planes.load_rules(rule_file))


def cases(spark: SparkSession, folder: str, rule_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, expectations held) of ``folder/<case>/expect.toml`` beside the case's bundle, and ``lock.json`` where an earlier state is needed. Unknown keys are errors."""
    files, expect, needs, locks = [], [], [], []
    for case in sorted(os.listdir(folder)):
        at = os.path.join(folder, case)
        if not os.path.exists(os.path.join(at, "expect.toml")):
            continue
        x = read_toml(os.path.join(at, "expect.toml"))
        if extra := set(x) - {"description", "requires", "expect"}:
            raise ValueError(f"unknown key in {case}: {sorted(extra)}")
        needs.append((case, x.get("requires", {}).get("kind", "available")))
        if needs[-1][1] not in gates.REQUIREMENTS:
            raise ValueError(f"unknown requirement in {case}: {needs[-1][1]}")
        for e in x["expect"]:
            if extra := set(e) - {"kind", *_FIELDS}:
                raise ValueError(f"unknown key in an expectation of {case}: {sorted(extra)}")
            expect.append((case, case, e["kind"], *(e.get(f) for f in _FIELDS)))
        for path, content, reason, _ in walk(at):
            if path == "lock.json" and content is not None:
                # A bundle's earlier state goes by the case's name, whatever it is named in the lock.
                locks += [(case, r["content_digest"], r["capabilities"]) for r in engine.read_lock(spark, content.decode()).toLocalIterator()][:1]
            elif path != "expect.toml" and reason is None:
                files.append((case, path, bytearray(content)))
    s = engine.scan(spark.createDataFrame(files, "root string, path string, content binary"), rule_file)
    # Each plane is asked for several times.
    caps, signals, open_, docs = (kept(x, scratch(spark, "suite")) for x in (s.capabilities, s.instructions, s.unresolved, s.manifests()))
    before = spark.createDataFrame(locks, "root string, content_digest string, capabilities array<string>")
    changes = state.diff_locks(before, s.lock()).join(before.select("root"), "root", "left_semi")
    held = kept(gates.hold(spark.createDataFrame(expect, _EXPECT), s.files, caps, signals, open_, docs, changes), scratch(spark, "held"))
    return gates.outcomes(spark.createDataFrame(needs, "case string, requires string"), held, "adversarial"), held


def run(spark: SparkSession, folder: str, rule_file: str | None = None) -> DataFrame:
    """``(suite, case, outcome)`` of both suites, as far as the folder has them."""
    out = fixtures(spark, folder, rule_file)
    at = os.path.join(folder, "adversarial")
    return out.unionByName(cases(spark, at, rule_file)[0]) if os.path.isdir(at) else out


def compared(results: DataFrame, baseline: str | None) -> DataFrame:
    """``(suite, passed, failed, pending, regressed)`` against a baseline's text."""
    spark = results.sparkSession
    before = spark.createDataFrame(list((gates.read_baseline(baseline) if baseline else {}).items()), "suite string, cases long")
    return gates.fewer(before, results).orderBy("suite")


def said(results: DataFrame, baseline: str | None) -> tuple[str, bool]:
    """(report, whether anything regressed): a line a suite, a line a case that failed."""
    rows = compared(results, baseline).collect()
    lines = [f"{r['suite']}: {r['passed']} passed, {r['failed']} failed, {r['pending']} pending{', regressed' if r['regressed'] else ''}" for r in rows]
    lines += [f"  failed: {r['case']}" for r in results.where(F.col("outcome") == "failed").orderBy("suite", "case").toLocalIterator()]
    return "\n".join(lines) + "\n", any(r["regressed"] for r in rows)
