"""run() against its stages done by hand on a small corpus."""

import os
from collections import Counter

import numpy as np

import corpus_pipeline
from capledger.llm import mixing, ngram_join, pieces, pii, quality
from tests.llm.test_operators import DOC, brute_pairs, corpus, words


def _write(spark, rows, d):
    spark.createDataFrame(rows, DOC).coalesce(1).write.parquet(os.path.join(d, "documents.parquet"))
    return str(d)


def test_run_is_its_stages(spark, tmp_path):
    rows = [(i, t and t + (" 4111111111111111" if i % 4 == 0 and i is not None else ""), lang, s, n) for i, t, lang, s, n in corpus() if i is not None] + [(900, "BUY!! " * 200, "en", "src1", 1)]
    d = _write(spark, rows, tmp_path)
    docs = spark.createDataFrame(rows, DOC)
    keep = {r.doc_id for r in quality.quality_scores(docs).where("keep").collect()}
    rows = [r for r in rows if r[0] in keep]
    g, at = ngram_join.gram_sets([r[1] or "" for r in rows], 3)
    s = [frozenset(g[at == k].tolist()) for k in range(len(rows))]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.6 - 1e-12:
                root[find(a)] = find(b)
    best = {}
    for k, r in enumerate(rows):
        best.setdefault(find(k) if s[k] else ("own", k), []).append((r[0], k))
    rows = [rows[min(v)[1]] for v in best.values()]
    see = pii.finder()
    rows = [(i, None if t is None else pii.mask(t, see(t)), lang, src, n) for i, t, lang, src, n in rows]
    chosen = mixing.mix_sources(spark.createDataFrame(rows, DOC)).collect()
    text = {r[0]: r[1] for r in rows}
    lat = pieces.Lattices(pieces.MODEL, pieces.ALPHA)
    want = Counter()
    for c in chosen:
        seed = pieces.mix(np.array([c.doc_id], np.int64).astype(np.uint64) + np.uint64((pieces.SEED * int(pieces.GOLDEN)) % 2**64))
        want[c.doc_id, tuple(lat.sample([text[c.doc_id] or ""], seed)[0].tolist()) if text[c.doc_id] is not None else None] += 1
    got = Counter((r.doc_id, tuple(r.pieces) if r.pieces is not None else None) for r in corpus_pipeline.run(spark, d).collect())
    assert got == want and len(got) > 10
    assert 900 not in {i for i, _ in got} and brute_pairs()


def test_run_of_an_empty_table_and_columns(spark, tmp_path):
    d = _write(spark, [], tmp_path)
    assert corpus_pipeline.run(spark, d).count() == 0
    docs = spark.createDataFrame([(1, words(80), "en", "src1", 5), (None, None, None, None, None)], DOC)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
