"""``python -m capledger``: the engine's verbs on folders of bundles. An unknown flag is an error; what can't run ends with 4."""

from __future__ import annotations

import argparse
import os
import sys

CANNOT = 4


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("capledger")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, help_: str, folder: bool = True) -> argparse.ArgumentParser:
        v = verbs.add_parser(name, help=help_, allow_abbrev=False)
        if folder:
            v.add_argument("folder", help="a folder of bundles, or with --direct one bundle")
            v.add_argument("--direct", action="store_true")
            v.add_argument("--rules", help="a file of rules instead of the shipped ones")
        return v

    verb("scan", "what is found in each bundle").add_argument("--format", choices=("json", "human"), default="human")
    verb("lock", "write the state of all bundles").add_argument("--lock", default="lock.json")
    ci = verb("ci", "hold bundles against a lock and a policy")
    ci.add_argument("--lock", default="lock.json")
    ci.add_argument("--policy")
    verb("rules", "id, languages and term of every rule", folder=False).add_argument("--rules")
    corpus = verb("corpus", "measures over all bundles")
    corpus.add_argument("--snapshot", default="unlabelled")
    corpus.add_argument("--seed", default="labels-1")
    corpus.add_argument("--head", action="append", default=[], help="roots of the head population")
    corpus.add_argument("--sample", action="store_true", help="write sample.json as well")
    corpus.add_argument("--out", default="corpus")
    ev = verb("eval", "run the suites of a folder and hold them against their baseline", folder=False)
    ev.add_argument("folder")
    ev.add_argument("--rules")
    ev.add_argument("--baseline")
    ev.add_argument("--bless", metavar="NOTE", help="write the baseline anew, with a note why")
    hook = verb("hook", "a session hook in a settings file", folder=False)
    hook.add_argument("action", choices=("install", "uninstall", "status", "run"))
    hook.add_argument("--settings", default=os.path.join(os.path.expanduser("~"), ".claude", "settings.json"))
    return p


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("capledger").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _save(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def run(a: argparse.Namespace, out=None) -> int:
    out = out or sys.stdout
    from capledger.operators import planes
    from capledger.sources import hook

    if a.verb == "rules":
        for r in planes.load_rules(a.rules):
            print(r["id"], ",".join(r["languages"]), r["term"], sep="\t", file=out)
        return 0
    if a.verb == "hook":
        if a.action == "run":  # must never stop a session
            return 0
        done = getattr(hook, a.action)(a.settings)
        print({"install": ("already there", "installed"), "uninstall": ("not there", "removed"), "status": ("not installed", "installed")}[a.action][done], file=out)
        return 0
    from capledger import ship
    from capledger.operators import manifest
    from capledger.plans import engine, reports

    if a.verb == "ci" and not os.path.exists(a.lock):
        print(f"no lock at {a.lock}: nothing to compare with", file=sys.stderr)
        return CANNOT
    spark = session()
    ship(spark)
    if a.verb == "eval":
        from capledger.operators import gates
        from capledger.plans import suites

        results = suites.run(spark, a.folder, a.rules).cache()
        path = a.baseline or os.path.join(a.folder, "baseline.json")
        old = None
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                old = f.read()
        text, worse = suites.said(results, old)
        out.write(text)
        if a.bless is not None:
            gates.bless(path, results, a.bless)
            return 0
        return int(worse)
    now = engine.scan_folder(spark, a.folder, a.direct, rule_file=a.rules)
    if a.verb == "scan":
        out.write(manifest.framed([r["json"] for r in now.manifests().orderBy("root").toLocalIterator()]) if a.format == "json" else reports.human(now))
    elif a.verb == "lock":
        _save(a.lock, engine.write_lock(now.lock()))
    elif a.verb == "corpus":
        _save(f"{a.out}/index.json", engine.index_json(now, a.snapshot))
        _save(f"{a.out}/report.md", reports.corpus_report(now, a.head, a.snapshot))
        if a.sample:
            _save(f"{a.out}/sample.json", engine.sample_json(now, a.snapshot, a.seed))
    else:
        with open(a.lock, encoding="utf-8") as f:
            lock = engine.read_lock(spark, f.read())
        c = engine.check(now, lock, *engine.load_policy(a.policy, spark))
        out.write(engine.report(c.changes) + reports.violations_text(c.violations))
        return c.exit_code
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a)
    except (OSError, ValueError) as e:
        print(f"capledger: {e}", file=sys.stderr)
        return CANNOT


if __name__ == "__main__":
    sys.exit(main())
