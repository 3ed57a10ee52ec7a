"""Odd tables for every operator and stage: nulls everywhere, clashing columns, repeats, no rows at all."""

import os

import pytest

from quillon.llm import decontaminate as clean
from quillon.llm import html_text, jaccard, langid, licenses, line_dedup, packing, quality, suffix_dedup, toxicity
from quillon.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
#: Columns named like those that operators make or use within, one with a dot, one in capitals.
CLASHING = ["id", "n", "at", "h1", "h2", "th", "fp", "sig", "keeper", "gram", "place", "mark", "rank", "spans", "items", "label", "score", "lang_pred", "n_lines", "N_DROPPED", "n_matches", "component_id", "n_words", "task", "data", "digest", "__ql_text", "__ql_drop", "a.b"]
LINE = "A line of more than forty code points, which many documents have."
ROWS = [(None, None), (None, f"{LINE}\nno id"), (1, None), (2, ""), (3, " \n\t\n"), (4, "12 34 ..."), (5, "same text here, twice over"), (5, "same text here, twice over"), (6, "long " * 40_000), (7, "\n" * 30_000), (8, "\u00e9\u4e2d \U0001f600 \x00 end")]
ROWS += [(k, f"text {k} of many\n{LINE}\nend {k}") for k in range(20, 28)]


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, None if i is None else "en", None, None, *(None if k % 2 else "v" for k in range(len(CLASHING)))) for i, t in rows], schema)


def bench(spark):
    return spark.createDataFrame([("q1", "ten words of an item that no other document has"), ("q2", None), (None, "x y z"), ("q3", "")], "item_id string, text string")


def labels(spark):
    return spark.createDataFrame([(20, 0, 1), (21, 1, 0), (None, 1, 1), (22, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")


APPLY = {
    "quality": lambda s, d: quality.judge(d, quality.fit(d, labels(s))),
    "jaccard": lambda s, d: jaccard.similarity_groups(d, size=4, percent=85),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s))),
    "licenses": lambda s, d: licenses.scan_licenses(d, licenses.known_digests(s)),
    "overlap": lambda s, d: clean.find_overlap(d, bench(s)),
    "decontaminate": lambda s, d: clean.decontaminate(d, bench(s)),
    "html": lambda s, d: html_text.extract(d, id_col="doc_id", html_col="text"),
    "language": lambda s, d: langid.identify(d, langid.fit(d)),
    "lines": lambda s, d: line_dedup.dedup_lines(d, hot_lines=3),
    "suffix": lambda s, d: suffix_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", APPLY)
def test_one_row_a_document(spark, name):
    docs = frame(spark, ROWS)
    got = APPLY[name](spark, docs).collect()
    key = "page_id" if name == "html" else "doc_id"
    assert sorted(str(r[key]) for r in got) == sorted(str(i) for i, _ in ROWS)
    assert APPLY[name](spark, docs.where("false")).count() == 0
    assert APPLY[name](spark, frame(spark, [(1, None), (2, None)])).count() == 2


def test_other_columns_stay(spark):
    docs = frame(spark, ROWS)
    for name in ("lines", "language", "toxicity", "decontaminate"):
        out = APPLY[name](spark, docs)
        assert {"a.b", "__ql_text", "source", "keeper"} <= set(out.columns)
        assert {r["a.b"] for r in out.select("`a.b`").collect()} == {"v"}


def test_packing_keeps_every_row(spark):
    pack = lambda d: packing.pack(d, tokenizer_path=tokenizer_path(), capacity=64)
    firsts = pack(frame(spark, ROWS)).where("piece = 0").collect()
    assert sorted(str(r.doc_id) for r in firsts) == sorted(str(i) for i, _ in ROWS)
    assert {(r.length, r.offset) for r in pack(frame(spark, [(1, None)])).collect()} == {(1, 0)}


@pytest.mark.parametrize("hot", [2, 6, 1000])
def test_lines_alike_with_and_without_hot_keys(spark, hot):
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.dedup_lines(frame(spark, ROWS), hot_lines=hot).collect() if r.doc_id is not None and r.doc_id >= 20}
    assert got == {k: (1, f"text {k} of many\nend {k}") if k < 27 else (0, f"text {k} of many\n{LINE}\nend {k}") for k in range(20, 28)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"])
def test_stages(spark, name):
    import corpus_pipeline

    stage, docs = dict(corpus_pipeline.STAGES)[name], frame(spark, ROWS)
    out = stage(spark, docs, SF)
    if name != "best_fit_packing":
        assert out.columns == docs.columns and [r["lang_pred"] for r in out.collect()].count("v") == 0
    ids = {r.doc_id for r in out.collect()}
    if name == "language_id":
        assert ids == {None, 5, 6, 8, *range(20, 28)}
    else:
        assert ids == {i for i, _ in ROWS}
    assert stage(spark, docs.where("false"), SF).count() == 0


@pytest.mark.parametrize("hot", [1, 1000])
def test_lines_count_documents_not_rows(spark, hot):
    """Distinct documents decide: four rows of one id and one of another are two documents."""
    rows = [(1, LINE)] * 4 + [(2, f"{LINE}\n" * 9)] + [(k, f"own {k}\n{LINE}{LINE}") for k in (1, 2, 3, 4, 5)] + [(5, f"own 5\n{LINE}{LINE}")]
    got = line_dedup.dedup_lines(frame(spark, rows), hot_lines=hot).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == sorted([(1, 0)] * 4 + [(2, 0)] + [(k, int(k < 5)) for k in (1, 2, 3, 4, 5, 5)])
    none = line_dedup.dedup_lines(frame(spark, [(k, LINE) for k in (1, 2, 3, 4)] + [(None, LINE)] * 3), hot_lines=hot).collect()
    assert sorted(str(r.doc_id) for r in none if r.n_dropped) == ["1", "2", "3", "None", "None", "None"]


def test_lines_of_one_long_document(spark):
    import time

    n = 200_000
    rows = [(k, LINE) for k in range(1, 6)] + [(0, "\n".join(LINE if k % 1000 == 0 else f"line {k}" for k in range(n)))]
    began = time.perf_counter()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert time.perf_counter() - began < 60
    assert (got[0].n_lines, got[0].n_dropped) == (n, n // 1000) and got[0].text == "\n".join(f"line {k}" for k in range(n) if k % 1000)


def test_language_stage_without_languages(spark):
    """Where no row has a language, only rows without a letter go."""
    import corpus_pipeline

    rows = [(1, "some words", None), (2, None, None), (3, "12 34", None), (4, "été", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == [1, 4]


def test_batches_of_texts_are_small(spark):
    """While a table is written, texts reach Python in batches of bounded bytes; the session's settings stay as they are."""
    import pyarrow as pa

    from quillon.llm.common import BATCH, materialize

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]}, pa.schema([("n", pa.int64()), ("bytes", pa.int64())]))

    wide = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('x', 4096) AS text").mapInArrow(sizes, "n long, bytes long")
    narrow = spark.range(0, 4000, 1, 1).mapInArrow(sizes, "n long, bytes long")
    assert BATCH[0] not in spark.conf.getAll
    got = materialize(wide, "wide").collect()
    assert sum(r.n for r in got) == 4000 and max(r.bytes for r in got) < 4 << 20
    assert [r.n for r in materialize(narrow, "narrow").collect()] == [4000]
    assert BATCH[0] not in spark.conf.getAll
    spark.conf.set(BATCH[0], "1m")
    try:
        assert max(r.bytes for r in materialize(wide, "own").collect()) < 2 << 20 and spark.conf.get(BATCH[0]) == "1m"
    finally:
        spark.conf.unset(BATCH[0])
