"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, scored in its context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_sample, free_names, materialize, named

_WORD = re.compile(r"\w+")
_QUOTES = re.compile(r"[\"“”„«»‟]")
#: Words that report what somebody else said.
REPORTING = frozenset("said says wrote called quoted quote says dit disait cite appelé sagte schrieb nannte zitat dijo escribió llamó cita".split())
STEMS = (4, 5, 6)


class LevenshteinAutomaton:
    """States are sparse rows of edit distances: positions of the word reachable within ``most`` edits."""

    def __init__(self, word: str, most: int) -> None:
        self.word, self.most = word, most

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((k, k) for k in range(min(self.most, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], char: str) -> tuple[tuple[int, int], ...]:
        word, most = self.word, self.most
        before = dict(state)
        out: list[tuple[int, int]] = []
        if before.get(0, most) < most:
            out.append((0, before[0] + 1))
        for at, had in state:
            if at == len(word):
                continue
            cost = had + (word[at] != char)
            if out and out[-1][0] == at:
                cost = min(cost, out[-1][1] + 1)
            cost = min(cost, before.get(at + 1, most) + 1)
            if cost <= most:
                out.append((at + 1, cost))
        return tuple(out)

    def distance(self, state: tuple[tuple[int, int], ...]) -> int | None:
        return state[-1][1] if state and state[-1][0] == len(self.word) else None


def left_by(word: str, most: int) -> set[str]:
    """What is left of a word with up to ``most`` letters out."""
    out = now = {word}
    for _ in range(most):
        now = {w[:k] + w[k + 1 :] for w in now for k in range(len(w))}
        out = out | now
    return out


def chance(toxic: int, clean: int, share: float) -> float:
    """How likely a term without a bearing on labels stands in ``toxic`` toxic texts or more of all it is in."""
    n = toxic + clean
    if not 0.0 < share < 1.0:
        return share
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(1 - share) + (n - k) * math.log(share) for k in range(clean + 1)]
    return min(1.0, math.fsum(map(math.exp, logs)))


@dataclass
class Lexicon:
    """Whole words and stems, the evidence each match carries, and what a text without any is worth."""

    words: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    #: (term, edits) -> share of training documents with such a match that are toxic
    worth: dict[tuple[str, int], float] = field(default_factory=dict)
    base: float = 0.0
    quoted: float = 0.35
    window: int = 6

    @staticmethod
    def edits(word: str) -> int:
        """How many edits a lexicon word may be away: none for short ones."""
        return 0 if len(word) < 5 else 1 if len(word) < 9 else 2

    @cached_property
    def trie(self) -> dict:
        root: dict = {}
        for word in self.words:
            node = root
            for char in word:
                node = node.setdefault(char, {})
            node[""] = word
        return root

    @cached_property
    def parts(self) -> set[str]:
        """Pieces of lexicon words, one more than its edits each: a match leaves one of them whole."""
        out = set()
        for word in self.words:
            n = self.edits(word) + 1
            cuts = [len(word) * k // n for k in range(n + 1)]
            out.update(word[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        return out

    @cached_property
    def part_lengths(self) -> tuple[int, ...]:
        return tuple(sorted({len(x) for x in self.parts}))

    @cached_property
    def rests(self) -> list[tuple[int, int, int, set[str]]]:
        """For each number of edits: shortest and longest word in reach, and what lexicon words leave with so many letters out.

        Two words that so many edits part leave a string in common, so no match fails this screen.
        """
        out = []
        for edits in range(3):
            own = [w for w in self.words if self.edits(w) == edits]
            if own:
                out.append((edits, min(map(len, own)) - edits, max(map(len, own)) + edits, set().union(*(left_by(w, edits) for w in own))))
        return out

    def lookup(self, word: str) -> tuple[str, int] | None:
        """The closest lexicon term of a word: a stem it begins with, or a word within its edits."""
        for n in STEMS:
            if word[:n] in self._stems and len(word) >= n:
                return word[:n], 0
        near = [x for x in self.rests if x[1] <= len(word) <= x[2]]
        if not near or not any(word[k : k + n] in self.parts for n in self.part_lengths for k in range(len(word) - n + 1)):
            return None
        if all(left_by(word, edits).isdisjoint(rests) for edits, _, _, rests in near):
            return None
        best: tuple[int, str] | None = None
        auto = LevenshteinAutomaton(word, 2)
        todo = [(self.trie, auto.start())]
        while todo:
            node, state = todo.pop()
            for char, below in node.items():
                if char == "":
                    edits = auto.distance(state)
                    if edits is not None and edits <= self.edits(below) and (best is None or (edits, below) < best):
                        best = (edits, below)
                elif after := auto.step(state, char):
                    todo.append((below, after))
        return None if best is None else (best[1], best[0])

    @cached_property
    def _stems(self) -> frozenset[str]:
        return frozenset(self.stems)


class Matcher:
    """Matches of texts, remembering the words that were looked up."""

    def __init__(self, lexicon: Lexicon, most: int = 200_000) -> None:
        self.lexicon, self.most = lexicon, most
        self.clean: set[str] = set()
        self.found: dict[str, tuple[str, int]] = {}

    def matches(self, text: str) -> list[tuple[str, int, bool]]:
        """(term, edits, quoted) of every matching word of a text, in order."""
        text = text.lower()
        words = _WORD.findall(text)
        distinct = set(words)
        for word in distinct - self.clean - self.found.keys():
            hit = self.lexicon.lookup(word)
            if hit:
                self.found[word] = hit
            else:
                self.clean.add(word)
        hits = distinct & self.found.keys()
        if len(self.clean) > self.most:
            self.clean.clear()
        out = []
        if hits:
            places = [m.span() for m in _WORD.finditer(text)]
            for at, word in enumerate(words):
                if word in hits:
                    out.append((*self.found[word], self._quoted(text, words, places, at)))
        if len(self.found) > self.most:
            self.found.clear()
        return out

    def _quoted(self, text: str, words: list[str], places: list[tuple[int, int]], at: int) -> bool:
        """In the window around a match: between quotation marks, or in a quotation that a reporting verb begins."""
        window = self.lexicon.window
        first, last = max(0, at - window), min(len(words), at + window + 1)
        before = text[places[first][0] : places[at][0]].rpartition("\n")[2]
        after = text[places[at][1] : places[last - 1][1] + 2].partition("\n")[0]
        marks = len(_QUOTES.findall(before))
        inside = marks % 2 == 1 and _QUOTES.search(after) is not None
        reported = not REPORTING.isdisjoint(words[first:at]) and marks > 0
        return inside or reported


def score_matches(found: list[tuple[str, int, bool]], lexicon: Lexicon) -> float:
    """Noisy-or of the matches' worth, less where they are quoted; the base share without any."""
    clear = 1.0 - lexicon.base
    for term, edits, quoted in found:
        clear *= 1.0 - lexicon.worth.get((term, edits), 0.0) * (lexicon.quoted if quoted else 1.0)
    return float(min(1.0, max(0.0, 1.0 - clear)))


_SKETCHES = 4


def _sketches(words: list[str]) -> list[int]:
    """Near copies share one of them at least, nearly always: least salted hashes of the 3-word windows."""
    hashes = [xxhash.xxh3_64_intdigest(" ".join(w)) for w in zip(words, words[1:], words[2:], strict=False)] or [xxhash.xxh3_64_intdigest(" ".join(words))]
    h = np.array(hashes, dtype=np.uint64)
    return [int(((h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)).min() >> np.uint64(1)) for salt in range(1, _SKETCHES + 1)]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_per_label: int = 6000,
    min_docs: int = 6,
    min_worth: float = 0.9,
    false_terms: float = 0.05,
) -> Lexicon:
    """Learn a lexicon from labelled rows, about ``max_per_label`` of each label at most.

    Only ids, texts and labels are read.  Near copies count once (by sketches of their windows).  A word or
    stem enters if it stands in ``min_docs`` toxic texts or more, its smoothed share of toxic texts is ``min_worth`` or more and
    that is no chance: tested against the sample's share of toxic texts, with about ``false_terms`` of the terms that enter
    false (Benjamini and Hochberg).  Their number has no bound but what the sample holds.  Each (term, edits) then gets its worth from a second pass over the sample, so a
    misspelling that is an ordinary word elsewhere is worth little.  Without toxic rows, or without clean ones, nothing matches.
    """
    picked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    picked = bounded_sample(picked.groupBy("id").agg(F.max("label").alias("label")), "id", max_per_label, by="label")
    picked = materialize(picked, "sample")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(picked), "id")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [_sketches(_WORD.findall(x.lower())) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("text"), *(pa.array([f[k] for f in found], pa.int64()) for k in range(_SKETCHES))], names=["id", "label", "text", *names])

    names = [f"s{k}" for k in range(_SKETCHES)]
    sample = own.select("id", "label", "text").mapInArrow(sketches, "id long, label int, text string, " + ", ".join(f"{c} long" for c in names))
    # of rows that share a sketch the least id stays, sketch after sketch
    for c in names:
        sample = sample.groupBy(c).agg(F.min_by(F.struct("id", "label", "text", *[x for x in names if x != c]), "id").alias("r")).select(c, "r.*")
    sample = materialize(sample.select("id", "label", "text"), "texts").repartition(6, "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
                words = {w for w in _WORD.findall(text.as_py().lower()) if not w.isdigit() and len(w) > 2}
                seen[label].update(words)
                seen[label].update({f"{w[:n]}*" for w in words for n in STEMS if len(w) > n})
        terms = [*(seen[0].keys() | seen[1].keys())]
        yield pa.RecordBatch.from_pydict({"term": terms, "toxic": [seen[1][t] for t in terms], "clean": [seen[0][t] for t in terms]}, schema=pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))

    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic:
        return Lexicon()
    # the sample's labels are dealt otherwise than the corpus's: shares are taken at equal weights
    weight = toxic / max(clean, 1)
    counts = materialize(sample.select("label", "text").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= min_docs), "terms")
    tested = counts.count()
    terms = counts.where((F.col("toxic") >= min_docs) & (F.col("toxic") >= min_worth * (F.col("toxic") + F.col("clean") * weight + 0.5))).collect()
    ranked = sorted((chance(r.toxic, r.clean, toxic / (toxic + clean)), r.term) for r in terms)
    level = max((p for k, (p, _) in enumerate(ranked, 1) if p <= false_terms * k / tested), default=-1.0)
    passed = {term for p, term in ranked if p <= level}
    terms = [r for r in terms if r.term in passed]
    # a stem that one word makes up nearly alone gives way to that word
    led = {}
    for r in terms:
        if not r.term.endswith("*"):
            for n in STEMS:
                led[r.term[:n]] = max(led.get(r.term[:n], 0), r.toxic)
    chosen = sorted((r.term[:-1] for r in terms if r.term.endswith("*") and led.get(r.term[:-1], 0) < 0.7 * r.toxic), key=lambda x: (len(x), x))
    stems: list[str] = []
    for stem in chosen:
        if not any(stem.startswith(x) for x in stems):
            stems.append(stem)
    words = [r.term for r in terms if not r.term.endswith("*") and not any(r.term.startswith(x) and len(r.term) > len(x) for x in stems)]
    lexicon = Lexicon(tuple(sorted(words)), tuple(stems))
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, seen = Matcher(shipped.value), Counter()
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
                found = {(t, e) for t, e, _ in matcher.matches(text.as_py())}
                seen.update((t, e, label) for t, e in found)
                seen["", 0 if found else 1, label] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_pydict({"term": [k[0] for k in keys], "edits": [k[1] for k in keys], "label": [k[2] for k in keys], "n": [seen[k] for k in keys]}, schema=pa.schema([("term", pa.string()), ("edits", pa.int32()), ("label", pa.int32()), ("n", pa.int64())]))

    n: dict[tuple[str, int, int], int] = {}
    for r in sample.select("label", "text").mapInArrow(weigh, "term string, edits int, label int, n long").groupBy("term", "edits", "label").agg(F.sum("n").alias("n")).collect():
        n[r.term, r.edits, r.label] = r.n
    lexicon.base = float(n.get(("", 1, 1), 0) / max(1.0, n.get(("", 1, 1), 0) + n.get(("", 1, 0), 0) / max(weight, 1e-9)))
    lexicon.base = min(0.5, lexicon.base)
    for term in (*lexicon.words, *lexicon.stems):
        exact = 0.0
        for edits in range(Lexicon.edits(term) + 1 if term in set(lexicon.words) else 1):
            t, c = n.get((term, edits, 1), 0), n.get((term, edits, 0), 0) * (1.0 if edits else weight)
            # a misspelling not seen in the sample is worth a little less than the word itself, one seen in a clean text much less
            lexicon.worth[term, edits] = (t + 2.0 * exact * 0.9) / (t + c + 2.0) if edits else (t + 0.5) / (t + c + 1.0)
            exact = lexicon.worth[term, 0]
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score`` and ``n_matches``; null and empty texts get the base share.

    The lexicon (bounded by the sample it is learned from) is broadcast; rows are scored one by one, whole; an empty
    table stays empty; other columns stay, but for those named like the two new ones.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("struct<score double, n_matches long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shipped.value)
        for texts in batches:
            found = [matcher.matches(x) if x else [] for x in texts]
            yield pd.DataFrame({"score": np.array([score_matches(x, shipped.value) for x in found], dtype=float), "n_matches": np.array([len(x) for x in found], dtype=np.int64)})

    own = free_names(docs, "tox")[0]
    keep = [named(c) for c in docs.columns if c.lower() not in (score_col.lower(), "n_matches")]
    scored = docs.withColumn(own, run(named(text_col)))
    return scored.select(*keep, F.col(f"{own}.score").alias(score_col), F.col(f"{own}.n_matches").alias("n_matches"))
