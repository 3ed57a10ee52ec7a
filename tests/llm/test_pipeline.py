"""The pipeline against plain Python, stage after stage, on the smallest test tables."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
SPACE = " \t\n\x0b\x0c\r"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def lines_stage(docs):
    key = lambda x: lower(x.strip(SPACE))
    held = {}
    for i, t in docs.items():
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(i)
    shared = {k: max(v) for k, v in held.items() if len(v) >= 5}
    return {i: "\n".join(x for x in t.split("\n") if shared.get(key(x), i) == i) for i, t in docs.items()}


def groups_stage(docs):
    sets, where, root = {}, {}, {i: i for i in docs}
    for i, t in docs.items():
        w = lower(t).split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
        for s in sets[i]:
            where.setdefault(s, set()).add(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(docs):
        for j in {j for s in sets[i] for j in where[s] if j > i}:
            common = len(sets[i] & sets[j])
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in docs.items() if find(i) == i}


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def hits(words, windows):
    out = set()
    for n, grams in windows.items():
        for p in range(len(words) - n + 1):
            if tuple(words[p : p + n]) in grams:
                out.update(range(p, p + n))
    return out


def clean_stage(docs, bench):
    windows = {}
    for t in bench:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        if n:
            windows.setdefault(n, set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = {}
    for i, t in docs.items():
        first = True
        while True:
            places = [m.span() for m in WORD.finditer(lower(t))]
            hit = hits([lower(t)[a:b] for a, b in places], windows)
            if first and hit and len(hit) > 0.8 * len(places):
                break
            first = False
            if not hit:
                out[i] = t
                break
            runs, at, new = sorted(hit), 0, ""
            start = runs[0]
            for p, q in zip(runs, [*runs[1:], None], strict=True):
                if q != p + 1:
                    new += t[at : places[start][0]]
                    at = places[p][1]
                    start = q
            t = new + t[at:]
    return out


def test_pipeline_by_brute_force(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from quillon.llm.packing import cut
    from quillon.llm.queries import tokenizer_path

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    want = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    want = clean_stage(groups_stage(lines_stage(want)), bench)
    plain, pieces = Tokenizer.from_file(tokenizer_path()), Counter()
    for i, t in want.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        for k, (at, n) in enumerate(cut(len(ids), 1024)):
            pieces[i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= sum(fill.values()) // 1024 + 2


def test_stages_keep_columns(spark):
    import corpus_pipeline

    rows = [(1, "A clean text about nothing much at all, told in some words.", "en", "s", 60), (2, None, None, None, None), (3, "1234", "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and 1 in {r.doc_id for r in after.collect()}
