"""Quality rules by distribution divergence: a document's histograms of character classes and of common words against those of its language."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capledger.llm.common import batches_by_chars, materialize

#: Disjoint classes; what is in none of them is the last, "other".
CLASSES = (("lower", r"\p{Ll}"), ("upper", r"\p{Lu}"), ("digit", r"\p{N}"), ("space", r"\s"), ("stop", r".,;:'"), ("loud", r"!?"), ("mark", r"#$%&*+=@^~_"), ("bar", r"|<>{}/\\\[\]"))
COMMON = {
    "en": "the of and to in a is that for it was on with as by be this are from at or an have not".split(),
    "fr": "le la les de des et un une du en est que qui dans pour pas sur au par avec il ce plus ne".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como es más o".split(),
}
CHAR_LIMIT, WORD_LIMIT = 0.14, 0.08
MIN_CHARS, MIN_WORDS = 240, 60
#: A small sample strays from its language by chance alone; the limits are that much wider.
CHAR_SLACK, WORD_SLACK = 2.6, 2.8


_FOUND = re.compile(r"[^\W\d_]+")


@functools.lru_cache(1)
def _table() -> np.ndarray:
    """Class of every code point; numbers that Python's words would take in (fractions, Roman numerals) are one beyond the last."""
    other = len(CLASSES)
    t = np.full(0x110000, other, np.uint8)
    cats = [unicodedata.category(chr(c)) for c in range(0x110000)]
    order = {name: n for n, (name, _) in enumerate(CLASSES)}
    for c, cat in enumerate(cats):
        if cat == "Ll":
            t[c] = order["lower"]
        elif cat == "Lu":
            t[c] = order["upper"]
        elif cat == "Nd":
            t[c] = order["digit"]
        elif cat[0] == "N":
            t[c] = other + 1
    t[[9, 10, 11, 12, 13, 32]] = order["space"]
    for name in ("stop", "loud", "mark", "bar"):
        t[[ord(c) for c in dict(CLASSES)[name].replace("\\\\", "\\").replace("\\[", "[").replace("\\]", "]")]] = order[name]
    return t


def count(texts: list[str | None], langs: list[str | None]) -> tuple[list, list, list]:
    """For each text: counts of its character classes and its length, of its words, and of the common words of its language."""
    table, other, digit = _table(), len(CLASSES), 2
    whole = [t or "" for t in texts]
    size = np.array([len(t) for t in whole])
    code = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(whole)), size)
    hist = np.bincount(row * (other + 2) + table[code], minlength=len(whole) * (other + 2)).reshape(len(whole), other + 2)
    odd = hist[:, other + 1] > 0
    hist[:, digit] += hist[:, other + 1]
    hist[:, other] = size
    chars, words, common = [], [], []
    for n, (t, lang) in enumerate(zip(texts, langs)):
        if t is None:
            chars.append(None)
            words.append(None)
            common.append(None)
            continue
        chars.append(hist[n, : other + 1].tolist())
        if lang not in COMMON:
            words.append(None)
            common.append(None)
            continue
        low = t.lower()
        if odd[n]:
            low = "".join(" " if unicodedata.category(c)[0] == "N" else c for c in low)
        found = _FOUND.findall(low)
        seen = Counter(found)
        words.append(len(found))
        common.append([seen[w] for w in COMMON[lang]])
    return chars, words, common


def _measured(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """df and its counts, in one pass of Arrow batches over the texts."""
    names = df.columns
    at, lang_at = names.index(text_col), names.index(lang_col)
    schema = T.StructType([*df.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__chars", T.ArrayType(T.IntegerType())), T.StructField("__words", T.IntegerType()), T.StructField("__common", T.ArrayType(T.IntegerType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for s, e in batches_by_chars(whole, at, 1_000_000):
                b = whole.slice(s, e - s)
                langs = b.column(lang_at).to_pylist()
                chars, words, common = count(b.column(at).to_pylist(), langs)
                more = [pa.array([x or "" for x in langs], pa.string()), pa.array(chars, pa.list_(pa.int32())), pa.array(words, pa.int32()), pa.array(common, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*names, "__lang", "__chars", "__words", "__common"])

    return df.mapInArrow(run, schema)


def _references(m: DataFrame) -> DataFrame:
    """Counts over all documents of each language; one row a language."""
    k = len(CLASSES) + 1
    words = max(map(len, COMMON.values()))
    sums = [F.sum(F.col("__chars")[i].cast("long")).alias(f"c{i}") for i in range(k)] + [F.sum("__words").cast("long").alias("wn")] + [F.sum(F.get(F.col("__common"), F.lit(i)).cast("long")).alias(f"w{i}") for i in range(words)]
    g = m.where("__chars is not null").groupBy("__lang").agg(*sums)
    return g.select(
        F.col("__lang").alias("__ref_lang"),
        F.array(*(F.col(f"c{i}") for i in range(k))).alias("__ref_chars"),
        F.col("wn").alias("__ref_n"),
        F.array_compact(F.array(*(F.col(f"w{i}") for i in range(words)))).alias("__ref_common"),
    )


def _with_rest(parts: Column, total: Column) -> Column:
    """The listed counts and what the total has besides."""
    return F.concat(F.transform(parts, lambda x: x.cast("long")), F.array(total.cast("long") - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))))


def js_distance(p: Column, np_: Column, q: Column, nq: Column) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of two count arrays with the given totals."""

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.ln(a / m)).otherwise(F.lit(0.0))

    each = F.zip_with(p, q, lambda a, b: F.struct((a / np_).alias("a"), (b / nq).alias("b")))
    total = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + term(x["a"], (x["a"] + x["b"]) / 2) + term(x["b"], (x["a"] + x["b"]) / 2))
    return F.round(F.sqrt(F.greatest(total / 2 / F.ln(F.lit(2.0)), F.lit(0.0))), 6)


def _judged(m: DataFrame, refs: DataFrame) -> DataFrame:
    k = len(CLASSES)
    j = m.join(refs, m["__lang"] == refs["__ref_lang"], "left")
    n = F.col("__chars")[k]
    ref_n = F.col("__ref_chars")[k]
    chars = js_distance(_with_rest(F.slice("__chars", 1, k), n), n, _with_rest(F.slice("__ref_chars", 1, k), ref_n), ref_n)
    wn = F.col("__words")
    words = js_distance(_with_rest(F.col("__common"), wn), wn, _with_rest(F.col("__ref_common"), F.col("__ref_n")), F.col("__ref_n"))
    j = j.withColumn("__cd", F.when((n >= MIN_CHARS) & (ref_n > 0), chars)).withColumn("__wd", F.when((wn >= MIN_WORDS) & (F.col("__ref_n") > 0), words))
    bad = F.coalesce(F.col("__cd") > CHAR_LIMIT + CHAR_SLACK / F.sqrt(n), F.lit(False)) | F.coalesce(F.col("__wd") > WORD_LIMIT + WORD_SLACK / F.sqrt(wn), F.lit(False))
    return j.withColumn("__keep", ~bad)


def quality_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, lang, char_distance, word_distance, keep)`` for every row.

    The distances are Jensen-Shannon distances (rounded to 6 places) to the language's histograms, which are counted over
    all its documents. A text under MIN_CHARS characters has no character distance, one under MIN_WORDS words, or of a
    language without a word list, no word distance (null); what has no distance is not rejected on its account, so
    empty texts and null texts are kept. A null language is a language of its own. Repeated rows count each time.
    """
    src = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{lang_col}`").cast("string").alias("__own"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    m = materialize(_measured(src, "__text", "__own").drop("__text"), "quality")
    return _judged(m, materialize(_references(m), "quality-references")).select(F.col("__id").alias("doc_id"), F.col("__own").alias("lang"), F.col("__cd").alias("char_distance"), F.col("__wd").alias("word_distance"), F.col("__keep").alias("keep"))


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df that ``quality_scores`` keeps, unchanged; columns may have any names."""
    narrow = df.select(F.col(f"`{lang_col}`").cast("string").alias("__own"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    # A table of a row a language: while the optimizer finds it small it is broadcast, and judging needs no shuffle of texts.
    refs = materialize(_references(_measured(narrow, "__text", "__own").drop("__text")), "quality-references")
    plain = df.select(*(F.col(f"`{c}`").alias(f"__c{n}") for n, c in enumerate(df.columns)))
    m = _measured(plain, f"__c{df.columns.index(text_col)}", f"__c{df.columns.index(lang_col)}")
    return _judged(m, refs).where("__keep").select(*(F.col(f"__c{n}").alias(c) for n, c in enumerate(df.columns)))


def scores_sql() -> str:
    """``quality_scores`` for DuckDB."""
    k = len(CLASSES)

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    cls = ", ".join("length(regexp_replace(text, {}, '', 'g'))".format(q("[^" + p + "]+")) for _, p in CLASSES)
    lists = " ".join(f"WHEN '{c}' THEN [{', '.join(map(q, ws))}]" for c, ws in COMMON.items())

    def js(p: str, n: str, r: str, m: str) -> str:
        t = f"list_transform(list_zip({p}, {r}), lambda z: struct_pack(a := z[1] / {n}, b := z[2] / {m}))"
        s = f"list_sum(list_transform({t}, lambda z: CASE WHEN z.a > 0 THEN z.a * ln(z.a / ((z.a + z.b) / 2)) ELSE 0.0 END + CASE WHEN z.b > 0 THEN z.b * ln(z.b / ((z.a + z.b) / 2)) ELSE 0.0 END))"
        return f"round(sqrt(greatest({s} / 2 / ln(2.0), 0.0)), 6)"

    sums = ", ".join(f"sum(c[{i + 1}])::BIGINT" for i in range(k + 1))
    wsum = ", ".join(f"sum(w[{i + 1}])::BIGINT" for i in range(max(map(len, COMMON.values()))))
    return f"""
WITH base AS (SELECT doc_id, lang, coalesce(lang, '') AS l, text, [{cls}, length(text)] AS c,
    CASE lang {lists} END AS listed, regexp_extract_all(lower(text), '\\p{{L}}+') AS ws FROM documents),
m AS (SELECT doc_id, lang, l, c, CASE WHEN listed IS NOT NULL AND text IS NOT NULL THEN len(ws) END AS n,
    CASE WHEN listed IS NOT NULL THEN list_transform(listed, lambda x: len(list_filter(ws, lambda y: y = x))) END AS w FROM base),
ref AS (SELECT l, [{sums}] AS rc, sum(n)::BIGINT AS rn, list_filter([{wsum}], lambda x: x IS NOT NULL) AS rw FROM m WHERE c[{k + 1}] IS NOT NULL GROUP BY l),
r AS (SELECT m.*, rc, rn, rw || [rn - list_sum(rw)::BIGINT] AS rwo, w || [n - list_sum(w)::BIGINT] AS wo,
    c[1:{k}] || [c[{k + 1}] - list_sum(c[1:{k}])::BIGINT] AS co, rc[1:{k}] || [rc[{k + 1}] - list_sum(rc[1:{k}])::BIGINT] AS rco FROM m LEFT JOIN ref USING (l)),
d AS (SELECT doc_id, lang, c[{k + 1}] AS chars, n,
    CASE WHEN c[{k + 1}] >= {MIN_CHARS} AND rc[{k + 1}] > 0 THEN {js('co', f'c[{k + 1}]', 'rco', f'rc[{k + 1}]')} END AS char_distance,
    CASE WHEN n >= {MIN_WORDS} AND rn > 0 THEN {js('wo', 'n', 'rwo', 'rn')} END AS word_distance FROM r)
SELECT doc_id, lang, char_distance, word_distance,
    NOT (coalesce(char_distance > {CHAR_LIMIT} + {CHAR_SLACK} / sqrt(chars), false) OR coalesce(word_distance > {WORD_LIMIT} + {WORD_SLACK} / sqrt(n), false)) AS keep FROM d
"""
