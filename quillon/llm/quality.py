"""Quality rules: text statistics, and a decision list learned from labelled statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, bounded_sample, materialize

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of ``STATS``; a null text counts as empty.

    A word is in a repeated window if any 3-word window over it occurs twice or more in the text.
    """
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    full = [x for x in lines if x.strip(SPACE)]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            covered = -1
            for at, window in enumerate(windows):
                if times[window] > 1:
                    repeated += at + 2 - max(covered, at - 1)
                    covered = at + 2
    return len(words), chars, symbols, len(full) - len(set(full)), repeated, len(lines)


def with_stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, STATS...) of every row's whole text; null texts count as empty, rows stand for themselves."""
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_stats(x.as_py()) for x in batch.column(1)]
            columns = zip(*found, strict=True) if found else [[] for _ in STATS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in STATS))


def base_failed() -> Column:
    """Too short, or more than half of its words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What a rule may test: name -> (numerator, denominator) of STATS; a denominator of 0 counts as 1.
FEATURES = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.col(top).cast("double") if bottom is None else F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1)).cast("double")


def feature_matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([stats[a].astype(float) / (1.0 if b is None else np.maximum(stats[b], 1).astype(float)) for a, b in FEATURES.values()], axis=1)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold), and its precision on rows held back for pruning."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float

    def mask(self, x: np.ndarray) -> np.ndarray:
        out, names = np.ones(len(x), dtype=bool), list(FEATURES)
        for name, sign, value in self.tests:
            column = x[:, names.index(name)]
            out &= column <= value if sign == "<=" else column > value
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, value in self.tests:
            out = out & (feature(name) <= value if sign == "<=" else feature(name) > value)
        return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int, cuts: int) -> list[tuple[str, str, float]]:
    """Add the test of greatest FOIL gain until only bad rows are covered or nothing gains."""
    tests: list[tuple[str, str, float]] = []
    inside = np.ones(len(x), dtype=bool)
    for _ in range(most):
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p or not n:
            break
        had, best = np.log2(p / (p + n)), (1e-9, None)
        for k, name in enumerate(FEATURES):
            values = x[inside, k]
            order = np.argsort(values, kind="stable")
            sorted_values, hits = values[order], np.cumsum(bad[inside][order])
            grid = np.unique(np.quantile(sorted_values, np.linspace(0, 1, cuts)))
            for low, high in zip(grid, grid[1:], strict=False):
                value = float((low + high) / 2)
                at = int(np.searchsorted(sorted_values, value, "right"))
                below = int(hits[at - 1]) if at else 0
                for sign, pos, total in (("<=", below, at), (">", p - below, len(values) - at)):
                    if pos and total < len(values):
                        gain = pos * (np.log2(pos / total) - had)
                        if gain > best[0]:
                            best = (gain, (name, sign, value))
        if best[1] is None:
            break
        tests.append(best[1])
        inside = Rule(tuple(tests), 0.0).mask(x)
    return tests


def learn(x: np.ndarray, bad: np.ndarray, *, min_precision: float = 0.95, min_rows: int = 5, max_rules: int = 24, max_tests: int = 4, cuts: int = 65) -> list[Rule]:
    """Sequential covering: grow a rule on two rows of three, prune it on the others, drop what it covers, go on.

    Pruning drops tests from the end while (p - n) / (p + n) does not fall.  A rule stays if it covers
    ``min_rows`` pruning rows or more at ``min_precision`` or more; the first that fails ends the list.
    No rows, or none of one class, give an empty list, which keeps everything.
    """
    held = np.random.default_rng(7).random(len(x)) < 1 / 3  # the same rows for the same sample
    rules: list[Rule] = []
    for _ in range(max_rules):
        grow = ~held
        if not bad[grow].any() or bad.all():
            break
        tests = _grow(x[grow], bad[grow], max_tests, cuts)
        best: tuple[float, float, int] | None = None
        for n in range(len(tests), 0, -1):
            inside = Rule(tuple(tests[:n]), 0.0).mask(x) & held
            p, total = int(bad[inside].sum()), int(inside.sum())
            worth = (2 * p - total) / total if total else -1.0
            if total >= min_rows and (best is None or worth >= best[0]):
                best = (worth, p / total, n)
        if best is None or best[1] < min_precision:
            break
        rule = Rule(tuple(tests[: best[2]]), best[1])
        rules.append(rule)
        left = ~rule.mask(x)
        x, bad, held = x[left], bad[left], held[left]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the number of the first rule that rejects, else null."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules))):
        out = F.when(rule.column(), F.lit(number)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **options) -> list[Rule]:
    """Learn a list from labelled rows that pass the base rules: about ``max_rows`` of them at most.

    The sample's ids (bounded by ``max_rows``) are broadcast to the scan, so no text is shuffled; the
    driver gets one short row of statistics a sampled document.  Null labels and labels without a
    document are left out.
    """
    picked = bounded_sample(labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null"), "id", max_rows)
    picked = materialize(picked.groupBy("id").agg(F.min("label").alias("label")), "sample")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked.select("id")), "id", "left_semi")
    rows = with_stats(own, id_col="id").where(~base_failed()).join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("doc_id", "label", *STATS).toPandas()
    rows = rows.sort_values(["doc_id", *STATS], kind="stable")
    if not len(rows):
        return []
    return learn(feature_matrix({k: rows[k].to_numpy() for k in STATS}), rows["label"].to_numpy() == 0, **options)


def judge(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, STATS, base_failed, rule, kept) of every row; ``rule`` numbers the first rule that rejects.

    Null and empty texts fail the base rules; an empty table stays empty; rows that repeat are judged
    alike; other columns are ignored.
    """
    stats = with_stats(docs, id_col=id_col, text_col=text_col)
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
