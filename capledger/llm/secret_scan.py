"""Secrets: an Aho-Corasick automaton finds keywords, each expression is tried at one place for each of its keywords met, and checksums inside a credential are verified."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame

from capledger.llm.spans import Span, disjoint, lowered, scan

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def crc62(body: str) -> str:
    """Six base-62 digits of the CRC-32 of a token's body."""
    v, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        v, r = divmod(v, 62)
        out = _B62[r] + out
    return out


def _crc_token(m: re.Match) -> float | None:
    body = m.group("body")
    return 0.99 if crc62(body[:-6]) == body[-6:] else None


def _jwt(m: re.Match) -> float | None:
    try:
        head = json.loads(base64.urlsafe_b64decode(m.group().split(".")[0] + "=="))
    except (ValueError, binascii.Error):
        return None
    return 0.9 if isinstance(head, dict) and "alg" in head else None


def _random(least: float, score: float) -> Callable[[re.Match], float | None]:
    return lambda m: score if entropy(m.group("body")) >= least else None


def _aws(m: re.Match) -> float | None:
    """Key ids are base 32 after their prefix; the decoded number's upper bit and spread tell them from words."""
    body = m.group("body")
    return 0.9 if entropy(body) >= 2.8 and any(c.isdigit() for c in body) else None


def _pem(m: re.Match) -> float | None:
    return 0.99


_ASSIGN = r"[\"'`]?\s{0,4}(?::=|=>|=|:)\s{0,4}"
_VALUE = r"(?:[\"'`](?P<quoted>[A-Za-z0-9+/_=.-]{20,})[\"'`]|(?P<bare>[A-Za-z0-9+/_.-]{20,}={0,2})(?![A-Za-z0-9+/_=.(\[-]))"
_PASSWORD = r"[\"'`](?P<body>[^\s\"'`]{8,})[\"'`]"


class Rule(NamedTuple):
    """An expression that is tried at one place for each keyword met: at the keyword's start or, with ``back``, where that expression (its end at the keyword) begins."""

    kind: str
    keywords: tuple[str, ...]
    pattern: str
    check: Callable[[re.Match], float | None]
    back: str = ""
    inner: bool = False


def _assigned(m: re.Match) -> float | None:
    """Without quotes a value has to be more random, and to have digits, as it may as well be a name."""
    if (v := m.group("quoted")) is not None:
        return 0.8 if entropy(v) >= 3.0 else None
    v = m.group("bare")
    return 0.75 if entropy(v) >= 3.5 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) else None


#: All bounds that open expressions have end at a character that their keyword begins with or that they exclude, so that no stretch of text is gone through for more than a few keywords.
RULES: tuple[Rule, ...] = (
    Rule("forge-token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<![A-Za-z0-9_])gh[pousr]_(?P<body>[A-Za-z0-9]{36})(?![A-Za-z0-9])", _crc_token),
    Rule("registry-token", ("npm_",), r"(?<![A-Za-z0-9_])npm_(?P<body>[A-Za-z0-9]{36})(?![A-Za-z0-9])", _crc_token),
    Rule("cloud-key-id", ("akia", "asia"), r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<body>[A-Z2-7]{16})(?![A-Za-z0-9])", _aws),
    Rule("api-key-google-style", ("aiza",), r"(?<![A-Za-z0-9_-])AIza(?P<body>[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])", _random(3.5, 0.9)),
    Rule("payment-key", ("sk_live_", "rk_live_"), r"(?<![A-Za-z0-9])[sr]k_live_(?P<body>[A-Za-z0-9]{24,})(?![A-Za-z0-9])", _random(3.3, 0.95)),
    Rule("chat-token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-"), r"(?<![A-Za-z0-9])xox[bpar]-(?P<body>[0-9]{8,14}-[A-Za-z0-9-]{18,80})", _random(3.0, 0.95)),
    Rule("model-key", ("sk-",), r"(?<![A-Za-z0-9_-])sk-(?P<body>[A-Za-z0-9_-]{32,})(?![A-Za-z0-9_-])", _random(3.8, 0.85)),
    Rule("jwt", ("eyj",), r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{20,}+", _jwt),
    Rule("private-key", ("private key-----",), r"-----BEGIN (?:[A-Z]{2,9} ){0,3}PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=\s:,.\\]|-(?!----))*+-----END (?:[A-Z]{2,9} ){0,3}PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/=]{16,}+)*+)", _pem, r"-----BEGIN (?:[A-Z]{2,9} ){0,3}"),
    Rule("url-password", ("://",), r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s:@/\"'<>]{1,64}:(?P<body>[^\s:@/\"'<>]{6,128})@[A-Za-z0-9.-]{1,255}", _random(2.0, 0.8), r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{1,15}", True),
    Rule("assigned-secret", ("token", "secret", "api_key", "apikey", "api-key", "access_key", "accesskey", "auth_key", "private_key", "client_key", "encryption_key", "signing_key"), r"(?i)(?:token|secret(?:[_-]?access)?(?:[_-]?key)?|api[_-]?key|access_?key|(?:auth|private|client|encryption|signing)_key)" + _ASSIGN + _VALUE, _assigned, inner=True),
    Rule("assigned-password", ("password", "passwd", "pwd"), r"(?i)(?:password|passwd|pwd)" + _ASSIGN + _PASSWORD, _random(2.5, 0.7), inner=True),
    Rule("bearer", ("bearer ",), r"(?i)(?<![a-z])bearer (?P<body>[A-Za-z0-9+/_=.-]{24,})", _random(3.5, 0.75), inner=True),
)
#: The most characters that a ``back`` expression takes.
BACK = 64


def value(rule: Rule, m: re.Match) -> tuple[int, int]:
    """Of an assignment the value, of most kinds the whole match."""
    return m.span(m.lastgroup) if rule.inner else m.span()


def finder() -> Callable[[str], list[Span]]:
    machine = ahocorasick.Automaton()
    by_word: dict[str, list[int]] = {}
    for r, rule in enumerate(RULES):
        for w in rule.keywords:
            by_word.setdefault(w, []).append(r)
    for w, rs in by_word.items():
        machine.add_word(w, (len(w), rs))
    machine.make_automaton()
    tried = [(r, re.compile(r.pattern).match, r.check, re.compile("(?:" + r.back + r")\Z").search if r.back else None) for r in RULES]

    def see(text: str) -> list[Span]:
        found: dict[tuple, Span] = {}
        for end, (size, rules) in machine.iter(lowered(text)):
            for r in rules:
                rule, match, check, back = tried[r]
                at = end + 1 - size
                if back:
                    # Cut before the keyword, with a character more for the look behind the expression's start.
                    if (b := back(text[max(0, at - BACK) : at])) is None:
                        continue
                    at = max(0, at - BACK) + b.start()
                if (m := match(text, at)) is None or (v := check(m)) is None:
                    continue
                span = value(rule, m)
                found[rule.kind, span] = (rule.kind, *span, v)
        return disjoint(list(found.values())) if found else []

    return see


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kind, start, end, score, found)`` of every credential in each text.

    A token of a kind that carries a checksum is reported only if the checksum holds, an assigned value only if it is
    random enough; a private key with all its lines. Of overlapping spans of one text that of the best score stays, then the longer. Null and empty texts have none; a null id is carried on; repeated
    rows give repeated results; texts of any length are read whole, each stretch once for the keywords and once for each that it follows. Other columns are ignored, whatever their names; ids are integers.
    """
    return scan(df, finder, None, id_col, text_col)
