"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_sample, free_names, named

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 15


@dataclass(frozen=True)
class LanguageModel:
    """Sorted language codes and a (2**bits, languages) matrix of log-probabilities."""

    langs: tuple[str, ...]
    matrix: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]
    bits: int


def grams(texts: Iterable[str], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sparse count matrix of hashed n-grams of lower-cased texts: (rows, buckets, counts), in blocks of bounded size.

    A row is a text's place in ``texts``.  Short texts share a block and long ones span several; a cell may
    come in several blocks, whose counts add up.
    """
    reach = max(orders) - 1
    block: list[tuple[int, np.ndarray]] = []
    size = 0
    for row, text in enumerate(texts):
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        for start in range(0, len(points), _CHUNK):
            piece = points[start : start + _CHUNK + reach]
            if size + len(piece) > _CHUNK and block:
                yield _cells(block, orders, bits)
                block, size = [], 0
            block.append((row, piece))
            size += len(piece)
    if block:
        yield _cells(block, orders, bits)


def _cells(block: list[tuple[int, np.ndarray]], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of pieces (row, code points); n-grams begin within a piece's first ``_CHUNK`` points and end within the piece."""
    lengths = np.array([len(piece) for _, piece in block])
    points = np.concatenate([piece for _, piece in block]).astype(np.uint32)
    row = np.repeat(np.array([row for row, _ in block], dtype=np.uint64), lengths) << np.uint64(bits)
    at = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.where(at < _CHUNK, np.repeat(lengths, lengths) - at, 0)
    h, found = np.zeros(len(points), dtype=np.uint32), []
    for n in range(1, max(orders) + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] * np.uint32(0x01000193)) ^ (points[n - 1 :] + np.uint32(n))
        if n in orders:
            begins = left[: len(h)] >= n
            mixed = (h[begins] ^ (h[begins] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            found.append(row[: len(h)][begins] | (mixed >> np.uint32(32 - bits)).astype(np.uint64))
    cells, counts = np.unique(np.concatenate(found), return_counts=True)
    return (cells >> np.uint64(bits)).astype(np.int64), (cells & np.uint64((1 << bits) - 1)).astype(np.int64), counts


def fit(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    orders: tuple[int, ...] = (1, 2, 3),
    bits: int = 16,
    alpha: float = 0.5,
    max_per_lang: int = 4000,
    max_langs: int = 1000,
) -> LanguageModel:
    """Fit on the labelled rows of ``docs``, at most about ``max_per_lang`` for each language.

    Rows without text or language are left out; without any, the model knows no language.
    Counts are made on the executors (a fixed number of tasks, each returning one vector a language).
    More than ``max_langs`` languages are an error, for the matrix is broadcast (256 kB a language at 16 bits).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = bounded_sample(rows.where("text is not null and lang is not null"), "id", max_per_lang, by="lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            langs, of = np.unique(np.array(batch.column(1).to_pylist(), dtype=object), return_inverse=True)
            own = np.zeros((len(langs), 1 << bits), dtype=np.int64)
            for row, bucket, times in grams((x.as_py() for x in batch.column(0)), orders, bits):
                np.add.at(own, (of[row], bucket), times)
            for k, lang in enumerate(langs):
                sums[lang] = sums.get(lang, 0) + own[k]
                seen[lang] = seen.get(lang, 0) + int((of == k).sum())
        yield pa.RecordBatch.from_pydict(
            {"lang": list(sums), "n": [seen[k] for k in sums], "counts": [v.tobytes() for v in sums.values()]},
            schema=pa.schema([("lang", pa.string()), ("n", pa.int64()), ("counts", pa.binary())]),
        )

    total: dict[str, np.ndarray] = {}
    docs_in: dict[str, int] = {}
    for row in rows.select("text", "lang").repartition(6).mapInArrow(count, "lang string, n long, counts binary").toLocalIterator():
        total[row.lang] = total.get(row.lang, 0) + np.frombuffer(row.counts, dtype=np.int64)
        docs_in[row.lang] = docs_in.get(row.lang, 0) + row.n
        if len(total) > max_langs:
            raise ValueError(f"more than {max_langs} languages to learn")
    langs = tuple(sorted(total))
    matrix = np.zeros((1 << bits, len(langs)), dtype=np.float32)
    for k, lang in enumerate(langs):
        smooth = total[lang] + alpha
        matrix[:, k] = np.log(smooth / smooth.sum())
    prior = np.log(np.array([docs_in[x] for x in langs], dtype=np.float64) / max(1, sum(docs_in.values())))
    return LanguageModel(langs, matrix, prior, tuple(orders), bits)


def score_texts(texts: Sequence[str | None], model: LanguageModel, evidence: int = 60) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its share of the posterior: one sparse product for the batch.

    A long text has far more n-grams than independent evidence, so the mean log-likelihood counts as
    ``evidence`` of them at most.  Ties go to the first code in order.  Null or no letter: ``und``, 0.
    """
    langs, shares = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    told = [k for k, x in enumerate(texts) if x is not None and _LETTER.search(x)] if model.langs else []
    if not told:
        return langs, shares
    total, n = np.zeros((len(told), len(model.langs))), np.zeros(len(told))
    for row, bucket, counts in grams((texts[k] for k in told), model.orders, model.bits):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        total[row[starts]] += np.add.reduceat(model.matrix[bucket] * counts[:, None].astype(np.float64), starts, axis=0)
        n[row[starts]] += np.add.reduceat(counts, starts)
    total = total * np.minimum(1.0, evidence / np.maximum(n, 1))[:, None] + model.prior
    weights = np.exp(total - total.max(axis=1, keepdims=True))
    best = total.argmax(axis=1)
    for k, b in zip(told, best, strict=True):
        langs[k] = model.langs[b]
    shares[told] = weights[np.arange(len(told)), best] / weights.sum(axis=1)
    return langs, shares


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; the matrix (bounded by its bits and languages) is broadcast.

    Whole texts are read, in blocks of bounded size.  Null or letterless texts give ``und`` and 0; an
    empty table stays empty; each row stands for itself, so ties and repeated rows need no rule; other
    columns stay, but for those named like the two new ones.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, shares = score_texts(texts.tolist(), shipped.value)
        return pd.DataFrame({"lang_pred": langs, "score": shares})

    own = free_names(docs, "lid")[0]
    keep = [named(c) for c in docs.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    scored = docs.withColumn(own, predict(named(text_col)))
    return scored.select(*keep, F.col(f"{own}.lang_pred").alias(lang_out), F.col(f"{own}.score").alias(score_out))
