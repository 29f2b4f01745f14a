"""Column expressions over paths, digests and texts. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from capledger.functions.vocabulary import CODE, CODE_EXTENSIONS, LANGUAGES, NAMES, SKIPS, STOPWORDS  # noqa: F401

def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def wire(hex_: Column) -> Column:
    return F.concat(F.lit("sha256:"), hex_)


def is_wire(x: Column) -> Column:
    """Only lower case digits with the prefix are a digest."""
    return x.rlike(r"^sha256:[0-9a-f]{64}\z")


def short_digest(x: Column) -> Column:
    return F.substring(F.regexp_replace(x, "^sha256:", ""), 1, 8)


def normalize_newlines(t: Column) -> Column:
    return F.regexp_replace(t, "\r\n?", "\n")


def is_binary(b: Column) -> Column:
    """A NUL among the first 8192 bytes."""
    return F.contains(F.substring(b, 1, 8192), F.unhex(F.lit("00")))


def basename(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)\z", 1)


def parent_dir(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)/[^/]*\z", 1)


def raw_extension(p: Column) -> Column:
    """What follows the last dot of the name, as written; empty without a dot."""
    return F.regexp_extract(basename(p), r"\.([^.]*)\z", 1)


def extension_of(p: Column) -> Column:
    return F.lower(raw_extension(p))


def language_of(p: Column) -> Column:
    """By the extension as written: ``X.PY`` is no Python here, though ``extension_of`` gives ``py``."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    names = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    return F.coalesce(F.when(raw_extension(p) == "", F.element_at(names, basename(p))).otherwise(F.element_at(table, raw_extension(p))), F.lit("unknown"))


def path_tokens(t: Column) -> Column:
    """Distinct runs of path characters that hold a slash, a backslash or a dot, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9._/\\~+-]+)"), F.lit(1)), lambda x: x.rlike(r"[/\\.]")))


def resolve_path(p: Column) -> Column:
    """Normal form relative to the root; null for what is absolute, under home, above the root or empty."""
    p = F.replace(p, F.lit("\\"), F.lit("/"))
    steps = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    none = F.lit(None).cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(none)
        return F.when(acc.isNull(), none).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    done = F.aggregate(steps, F.array().cast("array<string>"), step, lambda acc: F.when(acc.isNull() | (F.size(acc) == 0), F.lit(None).cast("string")).otherwise(F.array_join(acc, "/")))
    return F.when(p.startswith("/") | p.startswith("~"), F.lit(None).cast("string")).otherwise(done)


def trigger_terms(d: Column) -> Column:
    """Distinct words of three letters and more that aren't stopwords, sorted."""
    words = F.split(F.lower(d), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= 3) & ~w.isin(*STOPWORDS))))


def ends_with_component(v: Column, p: Column) -> Column:
    return (v == p) | F.endswith(v, F.concat(F.lit("/"), p))


def contains_component(v: Column, p: Column) -> Column:
    p = F.regexp_replace(p, "^/+|/+$", "")
    v = F.regexp_replace(v, "^/+|/+$", "")
    return (p != "") & F.contains(F.concat(F.lit("/"), v, F.lit("/")), F.concat(F.lit("/"), p, F.lit("/")))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def matches_lists(kind: Column, value: Column, prefixes: list[str], suffixes: list[str], inner: list[str]) -> Column:
    """Whether a folded value passes a rule's lists: an exact one by any, a tail by its end or inside, a rooted one by its beginning."""
    starts = any_of([F.startswith(value, F.lit(p)) for p in prefixes])
    ends = any_of([ends_with_component(value, F.lit(p)) for p in suffixes])
    holds = any_of([contains_component(value, F.lit(p)) for p in inner])
    return F.when(kind == "exact", starts | ends | holds).when(kind == "tail", ends | holds).when(kind == "rooted", starts).otherwise(False)


def contains_marker(t: Column, needle: str) -> Column:
    """The needle, and if it ends in a letter or digit, none of these after it."""
    return t.rlike("\\Q" + needle + "\\E" + ("(?![A-Za-z0-9])" if needle[-1:].isascii() and needle[-1:].isalnum() else ""))


def share_ppm(part: Column, total: Column) -> Column:
    """Whole millionths; null of nothing."""
    x, d = part.cast("long") * 1_000_000, F.nullif(total.cast("long"), F.lit(0).cast("long"))
    return ((x - F.pmod(x, d)) / d).cast("long")


def percent_text(n: Column, d: Column) -> Column:
    """``n/d (x.y%)`` in whole tenths, cut off; ``n/0 (n/a)``."""
    tenths = F.floor(n * 1000 / F.nullif(d, F.lit(0))).cast("long")
    return F.when(d == 0, F.concat(n.cast("string"), F.lit("/0 (n/a)"))).otherwise(F.concat(n.cast("string"), F.lit("/"), d.cast("string"), F.lit(" ("), F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%)")))


def line_count(t: Column) -> Column:
    """Lines, a newline at the end adding none."""
    return F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1))).cast("long")


LEFT, RIGHT, BROKEN = "<<<CAPLEDGER-UNTRUSTED", "CAPLEDGER-UNTRUSTED>>>", "[capledger: delimiter removed]"


def quoted(t: Column) -> Column:
    """The text on lines of its own between delimiters, none of which is left within it."""
    inner = F.replace(F.replace(t, F.lit(LEFT), F.lit(BROKEN)), F.lit(RIGHT), F.lit(BROKEN))
    return F.concat(F.lit(LEFT + "\n"), inner, F.lit("\n" + RIGHT))


def delimiters(t: Column) -> Column:
    """How many delimiters ``quoted`` breaks: the left ones, and the right ones in what is left then."""
    once = F.replace(t, F.lit(LEFT), F.lit(BROKEN))

    def count(x: Column, of: str) -> Column:
        return F.size(F.split(x, "\\Q" + of + "\\E", -1)) - 1

    return count(t, LEFT) + count(once, RIGHT)


def url_encode(t: Column) -> Column:
    """Bytes but letters, digits, ``-``, ``.``, ``_`` and ``~`` as percent and two upper case digits; a space is %20."""
    return F.replace(F.replace(F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def host_suffix(v: Column, suffixes: list[str]) -> Column:
    """Whether a host ends in one of the suffixes, as text: ``evilapi.example`` ends in ``api.example``."""
    return any_of([F.endswith(v, F.lit(s)) for s in suffixes])


def wilson(hits: Column, total: Column) -> tuple[Column, Column, Column]:
    """(point, low, high) at 95 %; the point of nothing is null and its interval everything."""
    z = 1.959963984540054
    n = total.cast("double")
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    none = total == 0
    return F.when(~none, F.round(p, 9)), F.when(none, 0.0).otherwise(F.round(F.greatest(mid - half, F.lit(0.0)), 9)), F.when(none, 1.0).otherwise(F.round(F.least(mid + half, F.lit(1.0)), 9))


def skip_class(reason: Column) -> Column:
    """A class for why something was passed over, which can be published where the reason can't."""
    r, out = F.lower(reason), F.lit("other")
    for needles, name in reversed(SKIPS):
        out = F.when(any_of([F.contains(r, F.lit(n)) for n in needles]), F.lit(name)).otherwise(out)
    return out
