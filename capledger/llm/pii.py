"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import bisect
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.llm.spans import Span, scan

ACCEPT = 0.5
WINDOW = 48
#: A text without either can hold none of the kinds.
GATE = r"[0-9]|@|::"
#: Characters of the longest candidate for an account number.
ACCOUNT = 64
IBAN_LENGTH = dict(zip("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split(), (20, 16, 22, 21, 28, 24, 22, 18, 20, 24, 18, 27, 22, 27, 21, 28, 22, 26, 27, 21, 20, 20, 21, 27, 31, 18, 15, 28, 25, 24, 24, 19, 24, 27)))


def luhn(s: str) -> bool:
    d = [int(c) for c in reversed(s) if c.isascii() and c.isdigit()]
    return len(set(d)) > 1 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod97(s: str) -> bool:
    s = re.sub(r"[ -]", "", s).upper()
    return len(s) == IBAN_LENGTH.get(s[:2], -1) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: Groups of digits with one separator between them.
_CHAIN = re.compile(r"(?<![\w.-])\d+(?:[ -]\d+)*(?![\w-]|\.\d)")
_GROUP = re.compile(r"\d+")
#: What a number within a longer candidate loses if cards don't begin or aren't printed so: it then needs a word that speaks for it.
UNUSUAL = 0.35


def cards(text: str, x: re.Pattern) -> Iterator[tuple[int, int, float]]:
    """Start, end and what the score loses of every card number. Where the longest candidate fails Luhn, every run of 13 to 19 digits between separators is tried, also across that candidate's end."""
    for chain in _CHAIN.finditer(text):
        if chain.end() - chain.start() < 13:
            continue
        groups = [m.span() for m in _GROUP.finditer(text, *chain.span())]
        tried = over = 0
        for i, (s, _) in enumerate(groups):
            if s < over:
                continue
            if s >= tried and (m := x.match(text, s)):
                tried = m.end()
                if luhn(m.group()):
                    over = m.end()
                    yield s, over, 0.0
                    continue
            n, least = 0, 99
            for a, b in groups[i:]:
                n, least = n + b - a, min(least, b - a)
                if n > 19:
                    break
                if n >= 13 and luhn(text[s:b]):
                    usual = least >= 3 and groups[i][1] - s >= 4 and (text[s] in "3456" or "22" <= text[s : s + 2] <= "27")
                    yield s, b, 0.0 if usual else UNUSUAL


def _account_end(text: str, m: re.Match) -> int:
    """Where an account number of the country's length ends within a candidate; the candidate's end if that is shorter."""
    n = IBAN_LENGTH.get(m.group()[:2].upper(), 0)
    for at in range(*m.span()):
        n -= text[at] not in " -"
        if not n:
            return at + 1
    return m.end()


def shorter(text: str, kind: str, x: re.Pattern, m: re.Match) -> Iterator[int]:
    """Ends of the shorter candidates that begin where m does and end at its group boundaries."""
    if kind == "iban":
        e = _account_end(text, m)
        if e < m.end() and text[e] in " -":
            yield e
    elif kind == "phone":
        yield from (e for e in range(m.end() - 1, m.start(), -1) if text[e] in " .-" and x.fullmatch(text, m.start(), e))


def candidates(text: str, kind: str, x: re.Pattern, valid: Callable[[str], bool]) -> Iterator[tuple[int, int, float]]:
    """Start, end and what the score loses of every confirmed span of one rule."""
    if kind == "card":
        yield from cards(text, x)
        return
    at = 0
    while m := x.search(text, at):
        s, e = m.span()
        ends = [e] if valid(m.group()) else [e for e in shorter(text, kind, x, m) if valid(text[s:e])][:1]
        if ends:
            yield s, ends[0], 0.0
            at = ends[0]
        else:  # another may begin at the second group
            at = next((k + 1 for k in range(s, e) if text[k] in " -"), e)


def _octets(s: str) -> bool:
    p = s.split(".")
    return all(len(x) == 1 or x[0] != "0" for x in p) and all(int(x) < 256 for x in p) and p[0] not in ("0", "255")


def _ipv6(s: str) -> bool:
    """Valid, and with four groups at least, as shorter ones are as well times or names."""
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return len([g for g in s.split(":") if g]) >= 4


def _phone(s: str) -> bool:
    n = sum(c.isdigit() for c in s)
    return 9 <= n <= 15 and len(set(re.sub(r"\D", "", s))) > 1


def _ssn(s: str) -> bool:
    a, b, c = s.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


def _nothing(s: str) -> bool:
    return True


#: kind, expression, validator, score once confirmed, words that speak for it, words that speak against it.
RULES: tuple[tuple[str, str, Callable[[str], bool], float, str, str], ...] = (
    ("email", r"(?<![\w.+@-])\w[\w.+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])", _nothing, 0.9, "email mail contact write courriel correo", ""),
    ("card", r"(?<![\w.-])(?:\d[ -]?){12,18}\d(?![\w-]|\.\d)", luhn, 0.8, "card visa credit mastercard amex carte karte tarjeta payment", "isbn order invoice tracking serial checksum"),
    ("iban", r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?:[ -]?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])", mod97, 0.95, "iban bank account konto compte cuenta", ""),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _octets, 0.7, "ip address host server adresse", "version release v section chapter"),
    ("ip", r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])", _ipv6, 0.75, "ip address host server adresse ipv6", ""),
    ("phone", r"(?<![\w+.-])0\d(?:[ .-]\d{2}){4}(?![\w-]|[ .]?\d)", _phone, 0.7, "phone tel call mobile fax telefon téléphone teléfono contact", "isbn version serial order invoice"),
    ("phone", r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]?\d{4}(?![\w-]|\.\d)", _phone, 0.7, "phone tel call mobile fax telefon téléphone teléfono contact", "isbn version serial order invoice"),
    ("phone", r"(?<![\w+.-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-]|\.\d)", _phone, 0.7, "phone tel call mobile fax telefon téléphone teléfono contact", "version serial order invoice"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn, 0.6, "ssn social security", "isbn part model version"),
)
_WORDS = re.compile(r"\w+")


def finder() -> Callable[[str], list[Span]]:
    rules = [(k, re.compile(x), v, s, frozenset(a.split()), frozenset(b.split())) for k, x, v, s, a, b in RULES]
    anchor = re.compile(GATE)
    account = re.compile(next(x for k, x, *_ in RULES if k == "iban"))

    def see(text: str) -> list[Span]:
        if not anchor.search(text):
            return []
        out = []
        for kind, x, valid, score, for_it, against in rules:
            if kind == "email" and "@" not in text:
                continue
            for s, e, loss in candidates(text, kind, x, valid):
                if kind == "card" and any(a.start() < s and e <= _account_end(text, a) and a.group()[:2].upper() in IBAN_LENGTH for a in account.finditer(text, max(0, s - ACCOUNT), min(len(text), e + ACCOUNT))):
                    continue  # digits of an account number, whatever their sum
                near = {w.lower() for w in _WORDS.findall(text[max(0, s - WINDOW) : s] + " " + text[e : e + WINDOW // 2])}
                v = min(1.0, score + 0.1 * bool(near & for_it)) - loss - 0.3 * bool(near & against)
                if v >= ACCEPT:
                    out.append((kind, s, e, round(v, 2)))
        return _disjoint(out)

    return see


def _disjoint(spans: list[Span]) -> list[Span]:
    """Best score first, then the longer, then the earlier; n log n, so that a text of nothing but numbers is no trouble."""
    starts: list[int] = []
    taken: list[Span] = []
    for s in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        i = bisect.bisect_left(starts, s[1])
        if (i and taken[i - 1][2] > s[1]) or (i < len(starts) and starts[i] < s[2]):
            continue
        starts.insert(i, s[1])
        taken.insert(i, s)
    return taken


def gate(text: Column) -> Column:
    return text.rlike(GATE)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kind, start, end, score, found)``: character offsets of every confirmed span of personal data.

    Card numbers must pass Luhn, IBANs mod 97 and their country's length, addresses their ranges. Where
    the longest candidate fails its check, the shorter ones between its separators are tried; a card number found so that
    begins or is grouped as none is printed needs a word that speaks for it. Spans of one text don't overlap: the better score stays, then the longer, then the earlier. Null and empty texts have none; a null id
    is carried on as null; repeated rows give repeated results; texts of any length are read whole. Other columns are ignored, whatever their names; ids are integers.
    """
    return scan(df, finder, gate, id_col, text_col)


def mask(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, s, e, _ in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df with every span in the text replaced by its kind in brackets; where a text changes, an integer column ``n_chars``, if there, becomes its new length. Other rows, null texts too, stay as they are."""
    names = df.columns
    text = F.col(f"`{text_col}`")
    at = names.index(text_col)
    hit = F.coalesce(gate(text), F.lit(False))
    size_at = names.index("n_chars") if dict(df.dtypes).get("n_chars") in ("int", "bigint") else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = finder()
        for b in it:
            old = b.column(at).to_pylist()
            new = [mask(t, spans) if t is not None and (spans := see(t)) else t for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if size_at is not None:
                cols[size_at] = pa.array([n if x is y else len(y) for n, x, y in zip(cols[size_at].to_pylist(), old, new)], b.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return df.where(hit).mapInArrow(run, df.schema).unionByName(df.where(~hit))
