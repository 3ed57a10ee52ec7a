"""Benchmark decontamination with a generalised suffix automaton over item words."""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import binary_texts, materialize

#: A-Z to lower case; every other ASCII byte that is no digit or lower-case letter to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text: runs of ASCII letters, digits and all code points above ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split() if text else []


class _Steps:
    """Transitions of an automaton under construction or in use: the first of each state in arrays, further ones in a dict.

    Most states have one transition, so a state costs 8 bytes instead of a dict of its own.
    """

    def __init__(self) -> None:
        self.char, self.to, self.more = array("i", [-1]), array("i", [0]), {}

    def __len__(self) -> int:
        return len(self.char)

    def get(self, state: int, c: int) -> int:
        """The state after ``c``, -1 if there is none."""
        if self.char[state] == c:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(c, -1)

    def put(self, state: int, c: int, to: int) -> None:
        if self.char[state] in (-1, c):
            self.char[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def new(self, like: int | None = None) -> int:
        """A further state: without transitions, or with those of another."""
        state = len(self.char)
        self.char.append(-1 if like is None else self.char[like])
        self.to.append(0 if like is None else self.to[like])
        if like in self.more:
            self.more[state] = dict(self.more[like])
        return state


@dataclass
class Automaton:
    """Generalised suffix automaton: transitions, suffix links and lengths, with the items of each window."""

    vocab: dict[bytes, int] = field(default_factory=dict)
    step: _Steps = field(default_factory=_Steps)
    link: array = field(default_factory=lambda: array("i", [-1]))
    length: array = field(default_factory=lambda: array("i", [0]))
    #: state in which a full window ends -> items with it
    full: dict[int, list[int]] = field(default_factory=dict)
    #: state in which a whole short item ends -> (its words, its number)
    short: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    #: state -> nearest state on its suffix path, itself included, with short items
    near: array = field(default_factory=lambda: array("i"))
    #: ids by number; an item without an id has None, hits words and is not listed
    items: list[str | None] = field(default_factory=list)
    window: int = 10
    least: int = 10

    def _state(self, length: int, link: int, like: int | None = None) -> int:
        self.length.append(length)
        self.link.append(link)
        return self.step.new(like)

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        q = step.get(last, c)
        if q >= 0:  # the string is known already
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state(length[last] + 1, 0)
        p = last
        while p >= 0 and (q := step.get(p, c)) < 0:
            step.put(p, c, new)
            p = link[p]
        if p >= 0:
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        step, link = self.step, self.link
        twin = self._state(self.length[p] + 1, link[q], q)
        link[q] = twin
        while p >= 0 and step.get(p, c) == q:
            step.put(p, c, twin)
            p = link[p]
        return twin

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words, for a state whose match is at least that long."""
        link, length, window = self.link, self.length, self.window
        while length[link[state]] >= window:
            state = link[state]
        return state


def build(items: list[tuple[str | None, bytes | None]], window: int = 10) -> Automaton:
    """The automaton of all items' words; an item shorter than a window counts as a whole."""
    auto = Automaton(window=window)
    coded = []
    for item_id, text in items:
        ids = array("i", [auto.vocab.setdefault(w, len(auto.vocab)) for w in words_of(text)])
        auto.items.append(item_id)
        coded.append(ids)
        last = 0
        for c in ids:
            last = auto._extend(last, c)
    auto.least = min([window, *(len(x) for x in coded if x)])
    for number, ids in enumerate(coded):
        state = 0
        for at, c in enumerate(ids, 1):
            state = auto.step.get(state, c)
            if at >= window:
                found = auto.full.setdefault(auto.window_state(state), [])
                if not found or found[-1] != number:
                    found.append(number)
        if 0 < len(ids) < window:
            auto.short.setdefault(state, []).append((len(ids), number))
    auto.near = array("i", [-1]) * len(auto.step)
    if auto.short:
        for state in sorted(range(1, len(auto.step)), key=auto.length.__getitem__):
            auto.near[state] = state if state in auto.short else auto.near[auto.link[state]]
    return auto


def scan(words: list[bytes], auto: Automaton) -> tuple[list[tuple[int, int]], set[int]]:
    """Hit spans [start, end) of a document's words, merged and in order, and the numbers of the items found."""
    spans: list[list[int]] = []
    found: set[int] = set()
    ids = list(map(auto.vocab.get, words))
    link, length, near, window, least = auto.link, auto.length, auto.near, auto.window, auto.least
    char, to, more = auto.step.char, auto.step.to, auto.step.more
    state = matched = 0
    for at, c in enumerate(ids):
        if c is None:
            state = matched = 0
            continue
        while True:  # down the suffix links to a state that goes on; the root knows every word of the vocabulary
            if char[state] == c:
                state = to[state]
                break
            own = more.get(state)
            if own is not None and c in own:
                state = own[c]
                break
            state = link[state]
            matched = length[state]
        matched += 1
        if matched < least:
            continue
        reach = 0
        if matched >= window:
            reach = window
            found.update(auto.full[auto.window_state(state)])
        short = near[state]
        while short > 0:
            for n, number in auto.short.get(short, ()):
                if n <= matched:
                    found.add(number)
                    reach = max(reach, n)
            short = near[link[short]]
        if reach:
            start = at + 1 - reach
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append([start, at + 1])
    return [(a, b) for a, b in spans], found


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    places = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def clean(text: bytes, auto: Automaton) -> bytes:
    """Cut hit spans until none is left: what a cut brings together may be a window too."""
    while spans := scan(words_of(text), auto)[0]:
        text = cut_spans(text, spans)
    return text


def item_pieces(text: bytes, window: int, most: int) -> list[bytes]:
    """The item itself; if it is longer than ``most`` bytes, pieces of it that have all its windows; nothing without words."""
    words = words_of(text)
    if not words or len(text) <= most:
        return [text] if words else []
    step = max(window, most // 16)
    return [b" ".join(words[k : k + step + window - 1]) for k in range(0, max(1, len(words) - window + 1), step)]


def automata(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = 10, block_bytes: int = 4_000_000) -> tuple[DataFrame, int]:
    """(table of pickled automata, their number), each over about ``block_bytes`` of items; most benchmarks are one.

    Tasks build them and write them to the shared folder; the driver sees their number only.  Items
    without words are left out; no items give no automaton.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0

        def pickled() -> pa.RecordBatch:
            made = pickle.dumps(build(block, window), 5)
            return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(made)]), pa.array([made], pa.binary())], names=["block", "automaton"])

        for batch in batches:
            for part, texts in binary_texts(batch, "text"):
                for item_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    for piece in item_pieces(text, window, block_bytes):
                        if block and held + len(piece) > 2 * block_bytes:  # the deal by hash is about even
                            yield pickled()
                            block, held = [], 0
                        block.append((item_id, piece))
                        held += len(piece)
        if block:
            yield pickled()

    dealt = items.repartition(n, F.xxhash64("item_id", "text")) if n > 1 else items.coalesce(1)
    blocks = materialize(dealt.mapInArrow(run, "block string, automaton binary"), "automata")
    return blocks, blocks.count()


def _ship(docs: DataFrame, blocks: DataFrame) -> Iterator:
    """One automaton after another as a broadcast; each goes before the next one comes, on the driver and on executors."""
    context = docs.sparkSession.sparkContext
    for row in blocks.select("block").distinct().collect():
        shipped = context.broadcast(pickle.loads(blocks.where(F.col("block") == row.block).first().automaton))
        yield shipped
        shipped.destroy()


def _row_hits(keyed: DataFrame, blocks: DataFrame, *, items: bool) -> DataFrame:
    """(row, spans, items) of the rows of ``keyed`` (row long, text) that any block hits, each block in a pass of its own.

    Only hits are written and meet by row number; spans are a flat list of start, end word numbers.
    """
    schema = pa.schema([("row", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    parts = []
    for shipped in _ship(keyed, blocks):

        def mark(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            auto = shipped.value
            for batch in batches:
                for part, texts in binary_texts(batch, "text"):
                    out = []
                    for number, text in zip(part.column(0).to_pylist(), texts, strict=True):
                        hit, found = scan(words_of(text), auto)
                        if hit:
                            out.append((number, [x for s in hit for x in s], sorted({auto.items[k] for k in found} - {None}) if items else []))
                    columns = zip(*out, strict=True) if out else [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        parts.append(materialize(keyed.select("row", "text").mapInArrow(mark, "row long, spans array<long>, items array<string>"), "hits"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    gathered = every.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[x for s in join_spans([*zip(flat[::2], flat[1::2], strict=True)]) for x in s] for flat in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, schema.types[1]), batch.column(2)], schema=schema)

    return materialize(gathered.mapInArrow(join, "row long, spans array<long>, items array<string>"), "row-hits")


def _found(docs: DataFrame, shipped, id_col: str, text_col: str) -> DataFrame:
    """One automaton: every row is scanned where it lies."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shipped.value
        for batch in batches:
            for part, texts in binary_texts(batch, "text"):
                n, spans, items = [], [], []
                for text in texts:
                    words = words_of(text)
                    hit, numbers = scan(words, auto)
                    n.append(len(words))
                    spans.append([x for s in hit for x in s])
                    items.append(sorted({auto.items[k] for k in numbers} - {None}))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(spans, schema.types[2]), pa.array(items, schema.types[3])], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, spans array<long>, items array<string>")


def _single(docs: DataFrame, blocks: DataFrame, n: int, window: int):
    """The one automaton of a small benchmark, or an empty one, as a broadcast that stays."""
    return docs.sparkSession.sparkContext.broadcast(pickle.loads(blocks.first().automaton) if n else build([], window))


def find_overlap(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 4_000_000) -> DataFrame:
    """Per document: ``n_words``, ``spans`` (flat list of start, end word numbers) and ``items`` (sorted ids).

    Words stream through the automaton, which tracks the longest match that ends at each word; a match of
    a whole window (or of a whole shorter item) is a hit.  The automaton is broadcast in blocks of bounded
    size: with one block no row is shuffled.  With several, rows get a number of their own, each block
    is one pass over the texts that writes hits only, and the hits of a row (never texts) meet by its number.

    Defined cases: a null text has no words; an item without words is never found; an item without an id
    hits words but is not listed; items that repeat an id are listed once; rows are answered one by one,
    whatever their ids, so rows that repeat an id or have none all come back; empty tables give no hits
    or no rows; other columns are ignored.
    """
    blocks, n = automata(benchmark, id_col=item_id_col, text_col=item_text_col, window=window, block_bytes=block_bytes)
    if n <= 1:
        return _found(docs, _single(docs, blocks, n, window), id_col, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    keyed = materialize(own, "numbered")
    counted = keyed.select("row", "doc_id", "text").mapInArrow(_count_words, "row long, doc_id long, n_words long")
    joined = counted.join(_row_hits(keyed, blocks, items=True), "row", "left")
    empty = lambda t: F.array().cast(f"array<{t}>")
    return joined.select("doc_id", "n_words", F.coalesce("spans", empty("bigint")).alias("spans"), F.coalesce("items", empty("string")).alias("items"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in binary_texts(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(words_of(t)) for t in texts], pa.int64())], names=["row", "doc_id", "n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_coverage: float = 0.8, block_bytes: int = 4_000_000) -> DataFrame:
    """``docs`` without benchmark spans; a document of which more than ``max_coverage`` of its words were hit goes.

    Rows are handled one by one, with no shuffle while the benchmark is one block.  With several, rows are
    numbered and take the spans of all blocks along, found on the same text; coverage is judged once on
    their union, which is cut at once, and texts that were cut are scanned by all blocks again until none
    hits: the result is that of one block.  Texts without a hit stay as they are, byte for byte; null texts
    stay null; an empty benchmark changes nothing.  Columns are kept; rows that repeat an id, or have none, stay apart.
    """
    names = docs.columns
    plain = [f"c{k}" for k in range(len(names))]  # a name with a dot cannot go to Python
    at = names.index(text_col)
    blocks, n = automata(benchmark, id_col=item_id_col, text_col=item_text_col, window=window, block_bytes=block_bytes)
    if not n:
        return docs
    if n > 1:
        return _cut_by_blocks(docs.toDF(*plain), blocks, at, max_coverage).toDF(*names)
    shipped = _single(docs, blocks, n, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shipped.value
        for batch in batches:
            for part, texts in binary_texts(batch, plain[at]):
                keep, new = [], []
                for text in texts:
                    words = words_of(text)
                    spans, _ = scan(words, auto)
                    hit = sum(b - a for a, b in spans)
                    keep.append(not hit or hit <= max_coverage * len(words))
                    new.append(clean(text, auto) if hit else text)
                columns = [*part.columns]
                columns[at] = pa.array(new, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return docs.toDF(*plain).mapInArrow(run, docs.schema)


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def _cut_by_blocks(docs: DataFrame, blocks: DataFrame, at: int, max_coverage: float) -> DataFrame:
    """Rounds over texts that may have hits: the spans of all blocks meet at the row, then their union is cut."""
    plain, text = docs.columns, docs.columns[at]
    todo = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    fields, out, first = todo.schema, None, True
    while True:
        found = _row_hits(todo.select("row", F.col(text).alias("text")), blocks, items=False).select("row", "spans")
        whole = todo.join(found, "row", "left_anti").select(*plain)
        out = whole if out is None else out.unionByName(whole)
        if found.isEmpty():
            return out

        def cut(batches: Iterator[pa.RecordBatch], first=first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in binary_texts(batch, text):
                    keep, new = [], []
                    for t, flat in zip(texts, part.column(len(fields)).to_pylist(), strict=True):
                        spans = [*zip(flat[::2], flat[1::2], strict=True)]
                        keep.append(not first or sum(b - a for a, b in spans) <= max_coverage * len(words_of(t)))
                        new.append(cut_spans(t, spans))
                    columns = [*part.columns[: len(fields)]]
                    columns[at] = pa.array(new, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(columns, names=fields.names).filter(pa.array(keep))

        hit = todo.join(found, "row").select(*plain, "row", "spans")
        todo, first = materialize(hit.mapInArrow(cut, fields), "cut"), False
