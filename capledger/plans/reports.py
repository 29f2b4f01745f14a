"""What people read: a scan, violations, and a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.functions import text as T
from capledger.operators import corpus
from capledger.plans import engine
from capledger.plans.engine import Scan


def rates(s: Scan, heads: list[str]) -> DataFrame:
    """(part, fact, n, of): how many bundles of the head, the tail and all have each fact, by one grouping set."""
    st = corpus.structure(s.files).select("root", "has_scripts", "has_unreferenced")
    parsed = s.unresolved.where("reason = 'parse_error' and lower(file) = 'skill.md'").select("root").distinct().withColumn("refused", F.lit(True))
    facts = st.join(parsed, "root", "left").select("root", F.col("root").isin(*heads).alias("is_head"), "has_scripts", "has_unreferenced", F.col("refused").isNull().alias("frontmatter_parsed"))
    names = ("has_scripts", "has_unreferenced", "frontmatter_parsed")
    g = facts.rollup("is_head").agg(F.grouping("is_head").alias("g"), F.count("*").alias("of"), *(F.count_if(n).alias(n) for n in names))
    part = F.when(F.col("g") == 1, "all").when(F.col("is_head"), "head").otherwise("tail").alias("part")
    return g.select(part, "of", F.explode(F.array(*(F.struct(F.lit(n).alias("fact"), F.col(n).alias("n")) for n in names))).alias("x")).select("part", "x.fact", "x.n", "of")


def corpus_report(s: Scan, heads: list[str], snapshot: str) -> str:
    """Markdown, the same for the same corpus."""
    r = {(x["fact"], x["part"]): x["t"] for x in rates(s, heads).select("fact", "part", T.percent_text(F.col("n"), F.col("of")).alias("t")).collect()}
    total = corpus.structure(s.files).agg(F.sum("total_bytes").alias("b"), F.sum("unreferenced_bytes").alias("u"), F.count("*").alias("n")).first()
    lines = [f"# Corpus {snapshot}", "", f"{total['n']} bundles, {total['b'] or 0} bytes, {total['u'] or 0} of them in files nothing points at.", "", "| Fact | Head | Tail | All |", "|-|-|-|-|"]
    lines += [f"| {f} | {' | '.join(r.get((f, p), '0/0 (n/a)') for p in ('head', 'tail', 'all'))} |" for f in sorted({k[0] for k in r})]
    lines += ["", "| Marker | Bundles | Only in unreferenced files |", "|-|-|-|"]
    lex = corpus.lexical(s.marks()).groupBy("marker").agg(F.count_if("hit").alias("n"), F.count_if("only_unreferenced").alias("u")).orderBy("marker").collect()
    lines += [f"| {x['marker']} | {x['n']} | {x['u']} |" for x in lex]
    lines += ["", "| Language | Bundles |", "|-|-|"]
    lines += [f"| {x['parsed_as']} | {x['bundles']} |" for x in corpus.frequency(s.files, "parsed_as", "root").orderBy(F.desc("bundles"), "parsed_as").collect()]
    top = s.files.select("root").distinct().groupBy(F.regexp_extract("root", "^([^/]*)", 1).alias("repo")).agg(F.count("*").alias("n"))
    first = top.agg(F.min_by(F.struct("repo", "n"), F.struct(-F.col("n"), "repo")).alias("x"), F.sum("n").alias("all")).select("x.*", "all").first()
    if first["n"] and first["n"] * 2 > first["all"] and first["all"] > 1:
        lines += ["", f"**{first['repo']} gives {first['n']} of {first['all']} bundles**: rates over all of them are mostly its own."]
    share = F.when(F.col("total_bytes") > 0, T.share_ppm(F.col("description_bytes"), F.col("total_bytes")))
    middle = engine.measure(s).agg(corpus.middle_ppm(share).alias("m"), F.count_if(share < 10_000).alias("low"), F.count(share).alias("n")).first()
    lines += ["", f"Median share of the description: {'n/a' if middle['m'] is None else f'{middle['m'] / 10_000:.2f}%'} of {middle['n']} bundles; under 1%: {middle['low']}."]
    lines += ["", "| Not told | Bundles |", "|-|-|"]
    lines += [f"| {x['reason']} | {x['n']} |" for x in s.unresolved.groupBy("reason").agg(F.count_distinct("root").alias("n")).orderBy("reason").collect()]
    lines += ["", "| Stratum | Bundles |", "|-|-|"]
    lines += [f"| {x['stratum']} | {x['n']} |" for x in engine.strata(s).where("stratum is not null").groupBy("stratum").agg(F.count("*").alias("n")).orderBy("stratum").collect()]
    keys = corpus.governance(s.files, s.heads).select("root", F.explode("extra_frontmatter_keys").alias("key"))
    lines += ["", "| Other key | Bundles |", "|-|-|"]
    lines += [f"| {x['key']} | {x['bundles']} |" for x in corpus.frequency(keys, "key", "root").orderBy(F.desc("bundles"), "key").limit(20).collect()]
    return "\n".join(lines) + "\n"


def coverage(s: Scan) -> DataFrame:
    """(root, code, prose, unread): files that were read as code, as prose, and not at all."""
    code = F.col("parsed_as").isin(*T.CODE)
    return s.files.groupBy("root").agg(F.count_if(code).alias("code"), F.count_if(F.col("parsed_as") == "markdown").alias("prose"), F.count_if(~code & (F.col("parsed_as") != "markdown")).alias("unread"))


def human(s: Scan) -> str:
    """Each bundle's findings with file and line."""
    cover = {r["root"]: r for r in coverage(s).collect()}
    caps: dict[str, list[str]] = {}
    for r in s.capabilities.orderBy("root", "term").toLocalIterator():
        e = r["evidence"][0]
        caps.setdefault(r["root"], []).append(f"  {r['term']} ({r['reachability']}) {e['file']}:{e['start_line']} [{e['rule_id']}]")
    for r in s.instructions.orderBy("root", "signal").toLocalIterator():
        e = r["evidence"][0]
        caps.setdefault(r["root"], []).append(f"  {r['signal']} {e['file']}:{e['start_line']} [{e['rule_id']}]")
    open_ = {r["root"]: r["n"] for r in s.unresolved.groupBy("root").agg(F.count("*").alias("n")).collect()}
    out = []
    for root, c in sorted(cover.items()):
        out += [f"{root}: {c['code']} code files, {c['prose']} prose files, {c['unread']} not read, {open_.get(root, 0)} unresolved", *caps.get(root, ["  nothing found in what was read"])]
    return "\n".join(out) + "\n"


def violations_text(broken: DataFrame) -> str:
    return "".join(f"{r['root']}: {r['term']} is not allowed, {r['first']['file']}:{r['first']['start_line']} [{r['first']['rule_id']}]\n" for r in broken.orderBy("root", "term").toLocalIterator())


def coverage_sentence(s: Scan) -> str:
    """What the findings rest on, over all bundles."""
    r = coverage(s).agg(F.sum("code").alias("c"), F.sum("prose").alias("p"), F.sum("unread").alias("u")).first()
    return f"Read {r['c'] or 0} files of code and {r['p'] or 0} of prose; {r['u'] or 0} were not read, and nothing is said of them.\n"


def variance_text(table: DataFrame, runs: int) -> str:
    """What repeated model calls agree on. table: of ``advisory.variance``."""
    lines = [f"{r['kind']}: in {r['runs_present']} of {runs} runs, {r['stable']} of {r['findings']} findings in all of them" for r in table.orderBy("kind").toLocalIterator()]
    return "\n".join(lines or [f"nothing in {runs} runs"]) + "\n"
