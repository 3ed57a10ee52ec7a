"""Suffix-array dedup: bytes under long strings that start earlier too are removed.

Suffixes are sorted by a distributed merge sort that knows common prefixes: tasks sort their suffixes
into front-coded runs, runs are exchanged, and loser trees merge them without comparing again what
they know to be common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, repeated

GRAM = 48


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all strings of ``GRAM`` = 32 + 16 bytes, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    parts, n = {1: h}, 1
    while n < 32:
        factor = np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64))
        h = h[: len(h) - n] * factor + h[n:]
        h = h ^ (h >> np.uint64(31))
        n *= 2
        parts[n] = h
    top = len(data) - GRAM + 1
    h = parts[32][:top] * np.uint64(0xA24BAED4963EE407) + parts[16][32 : 32 + top]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def anchors(data: np.ndarray, length: int, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of the grams that stand for windows of ``length`` bytes.

    The gram of least hash in a window (the first of equal ones) depends on the window's bytes alone, so
    equal windows have equal grams at equal places.  Each gram stands for consecutive windows.
    """
    if len(data) < length:
        empty = np.zeros(0, dtype=np.int64)
        return empty.view(np.uint64), empty, empty, empty
    wide = length - GRAM + 1
    out_h, out_a, out_p = [], [], []
    for start in range(0, len(data) - length + 1, block):
        piece = data[start : start + block + length - 1]
        h = gram_hashes(piece)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        least, n = key, 1
        while 2 * n <= wide:
            least = np.minimum(least[: len(least) - n], least[n:])
            n *= 2
        if n < wide:
            least = np.minimum(least[: len(key) - wide + 1], least[wide - n : wide - n + len(key) - wide + 1])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out_h.append(h[at[new]])
        out_a.append(at[new] + start)
        out_p.append(new + start)
    h, a, first = np.concatenate(out_h), np.concatenate(out_a), np.concatenate(out_p)
    last = np.concatenate((first[1:] - 1, [len(data) - length]))
    return h, a, first, last


def common_prefix(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    n = min(len(x), len(y))
    if x[at:n] == y[at:n]:
        return n
    step = 16
    while x[at : at + step] == y[at : at + step]:
        at += step
    while x[at] == y[at]:
        at += 1
    return at


def front_code(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Lengths shared with the key before, and what follows them, of sorted keys."""
    shared, tails, before = [], [], b""
    for key in keys:
        n = common_prefix(before, key, 0)
        shared.append(n)
        tails.append(key[n:])
        before = key
    return shared, tails


def front_decode(shared: list[int], tails: list[bytes]) -> Iterator[tuple[int, bytes]]:
    before = b""
    for n, tail in zip(shared, tails, strict=True):
        before = before[:n] + tail
        yield n, before


class LoserTree:
    """Merges sorted runs of (key, payload), each key with the length it shares with the one before in its run.

    Every run's head carries the length of the prefix it shares with the last key that came out.  Of two
    heads the one that shares more is the smaller, unread; only at equal lengths are bytes compared, from
    there on.  What a lost game found is kept at its node, so no byte is read twice.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, tuple]]]) -> None:
        self.runs = runs
        self.n = max(1, len(runs))
        self.heads: list[tuple[bytes, tuple] | None] = [None] * self.n
        self.lcp = [0] * self.n
        for k, run in enumerate(runs):
            self._pull(k, run)
        self.losers = [-1] * self.n
        self.top = self._build(1) if runs else -1

    def _pull(self, k: int, run: Iterator) -> None:
        got = next(run, None)
        if got is None:
            self.heads[k] = None
            self.lcp[k] = -1
        else:
            self.lcp[k] = got[0]
            self.heads[k] = (got[1], got[2])

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of a and b; the loser stays at ``node`` with the length it shares with the winner."""
        lcp = self.lcp
        if lcp[a] > lcp[b]:
            win, lose = a, b
        elif lcp[b] > lcp[a]:
            win, lose = b, a
        elif lcp[a] < 0:
            win, lose = a, b
        else:
            x, y = self.heads[a], self.heads[b]
            n = common_prefix(x[0], y[0], lcp[a])
            if (x[0][n : n + 1], x[1]) <= (y[0][n : n + 1], y[1]):
                win, lose = a, b
            else:
                win, lose = b, a
            lcp[lose] = n
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, tuple]]:
        """(length shared with the key before, key, payload) in order."""
        while self.top >= 0 and self.heads[self.top] is not None:
            k = self.top
            key, payload = self.heads[k]
            yield self.lcp[k], key, payload
            self._pull(k, self.runs[k])
            node, win = (k + self.n) // 2, k
            while node:
                win = self._play(node, self.losers[node], win)
                node //= 2
            self.top = win


# ---- stages --------------------------------------------------------------------------------------------

_TEXT_BITS = 0xFFFF
#: Stands for a null id: it sorts before all others.
NULL_ID = -(1 << 63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.xxhash64(text).bitwiseAND(_TEXT_BITS)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.cast("binary").alias("data"), mark.alias("mark"))


def _copies(keyed: DataFrame) -> DataFrame:
    """(doc_id, mark, n) of whole texts that an earlier id has too, by two 64-bit hashes; n counts their bytes."""
    rows = keyed.select("doc_id", "mark", F.xxhash64("data").alias("h1"), F.xxhash64(F.lit(0x51ED), "data").alias("h2"), F.octet_length("data").cast("long").alias("n"))
    first = rows.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    return rows.join(first.select("h1", "h2", "n", "first"), ["h1", "h2", "n"]).where("doc_id <> first").select("doc_id", "mark", "n").distinct()


def _pressed(keyed: DataFrame) -> DataFrame:
    """Texts compressed for their exchange: (doc_id, mark, data)."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([press.compress(x.as_buffer()) for x in part.column(2)], pa.binary())], schema=schema)

    return keyed.select("doc_id", "mark", "data").mapInArrow(run, "doc_id long, mark long, data binary")


def _pack(first: np.ndarray, last: np.ndarray, at: np.ndarray, mark: int) -> np.ndarray:
    """First window (36 bits), windows after it (6), the gram's distance (6) and the text's mark (16) as one long."""
    return ((first << 28) | ((last - first) << 22) | ((at - first) << 16) | mark).astype(np.int64)


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """(gram, doc_id, place) of the anchors of all texts whose gram stands at two places or more."""
    schema = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                grams, places, sizes = [], [], []
                for data, mark in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    h, at, first, last = anchors(np.frombuffer(data.as_buffer(), dtype=np.uint8), length)
                    grams.append(h)
                    places.append(_pack(first, last, at, mark))
                    sizes.append(len(h))
                ids = part.column(0)
                rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pc.take(ids, rows), pa.array(np.concatenate(places))], schema=schema)

    return repeated(keyed.mapInArrow(run, "gram long, doc_id long, place long"), "gram")


_RUN = "part int, doc_id binary, place binary, gram binary, shared binary, sizes binary, tails binary, n long"
_SPANS = "doc_id long, mark long, first long, last long"

def _runs(met: DataFrame, parts: int, length: int, rows: int = 120_000) -> DataFrame:
    """Sorted front-coded runs of the strings that anchors stand for, by partition of their gram; and,
    within a run, spans of strings that the run itself has earlier (negative parts, dealt anywhere).

    ``met``: (doc_id, compressed data, grams, places).  A string goes from an anchor's first window to the end of its last.
    """
    names = ["part", "doc_id", "place", "gram", "shared", "sizes", "tails", "n"]
    kinds = [pa.int32(), *[pa.binary()] * 6, pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def emit(items: list[tuple[int, bytes, int, int, int]]) -> Iterator[pa.RecordBatch]:
        items.sort()
        press = zstandard.ZstdCompressor(level=3)
        out: list[tuple] = []
        at = 0
        twice: list[tuple[int, int]] = []
        while at < len(items):
            part = items[at][0]
            keys, ids, places, grams, before = [], [], [], [], None
            while at < len(items) and items[at][0] == part:
                _, key, doc_id, place, gram = items[at]
                at += 1
                if key == before:
                    if (doc_id, place) != (ids[-1], places[-1]):  # else a row that stands twice
                        twice.append((doc_id, place))
                    continue
                before = key
                keys.append(key)
                ids.append(doc_id)
                places.append(place)
                grams.append(gram)
            shared, tails = front_code(keys)
            pack = lambda x, t: np.array(x, dtype=t).tobytes()
            out.append((part, pack(ids, "<i8"), pack(places, "<i8"), pack(grams, "<i8"), pack(shared, "<u2"), pack([len(t) for t in tails], "<u2"), press.compress(b"".join(tails)), len(keys)))
        if twice:
            out.append((-1 - twice[0][1] % parts, np.array([d for d, _ in twice], "<i8").tobytes(), np.array([p for _, p in twice], "<i8").tobytes(), b"", b"", b"", b"", len(twice)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[int, bytes, int, int, int]] = []
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc_id, data, grams, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = press.decompress(data.as_buffer())
                g = np.frombuffer(grams.values.buffers()[1], dtype=np.int64)[grams.values.offset : grams.values.offset + len(grams.values)]
                p = np.frombuffer(places.values.buffers()[1], dtype=np.int64)[places.values.offset : places.values.offset + len(places.values)]
                first = p >> 28
                last = first + ((p >> 22) & 63)
                for part, a, b, place, gram in zip((g.view(np.uint64) % np.uint64(parts)).tolist(), first.tolist(), (last + length).tolist(), p.tolist(), g.tolist(), strict=True):
                    items.append((part, data[a:b], doc_id, place, gram))
                if len(items) >= rows:
                    yield from emit(items)
                    items = []
        yield from emit(items)

    return met.mapInArrow(run, _RUN)


def _merge(runs: DataFrame, length: int) -> DataFrame:
    """Spans (first and last window that starts earlier too) of all strings of a partition's runs.

    Runs are merged; of equal strings all but the earliest are spans whole.  The earliest of different
    strings that share a gram are then compared window by window, aligned at the gram.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def decode(row: dict) -> Iterator[tuple[int, bytes, tuple]]:
        ids, places, grams = (np.frombuffer(row[k], "<i8").tolist() for k in ("doc_id", "place", "gram"))
        shared, sizes = (np.frombuffer(row[k], "<u2").tolist() for k in ("shared", "sizes"))
        ends = np.cumsum(sizes).tolist()
        whole = zstandard.ZstdDecompressor().decompress(row["tails"])
        tails = [whole[e - s : e] for e, s in zip(ends, sizes, strict=True)]
        for (n, key), doc_id, place, gram in zip(front_decode(shared, tails), ids, places, grams, strict=True):
            yield n, key, (doc_id, place, gram)

    def windows(members: list[tuple[bytes, tuple]], out: list[tuple[int, int, int, int]]) -> None:
        """members: earliest of each string of one gram.  Window by window, aligned at the gram, all but the earliest are spans."""
        members.sort(key=lambda m: m[1])
        places = [(key, payload, (payload[1] >> 16) & 63, (payload[1] >> 22) & 63) for key, payload in members]
        by_reach: dict[int, list] = {}
        for x in places:
            for distance in range(x[2] - x[3], x[2] + 1):
                by_reach.setdefault(distance, []).append(x)
        hits: dict[int, list[int]] = {}
        for distance, own in by_reach.items():
            if len(own) < 2:
                continue
            seen = set()
            for key, payload, back, _ in own:
                at = back - distance
                window = key[at : at + length]
                if window in seen:
                    hits.setdefault(id(payload), [payload]).append((payload[1] >> 28) + at)
                else:
                    seen.add(window)
        for payload, *starts in hits.values():
            starts.sort()
            a = b = starts[0]
            for s in starts[1:]:
                if s != b + 1:
                    out.append((payload[0], payload[1] & _TEXT_BITS, a, b))
                    a = s
                b = s
            out.append((payload[0], payload[1] & _TEXT_BITS, a, b))

    def batch_of(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    def one(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        groups: dict[int, list[tuple[bytes, tuple]]] = {}
        best: tuple | None = None
        now = b""

        def span(payload: tuple) -> None:
            a = payload[1] >> 28
            out.append((payload[0], payload[1] & _TEXT_BITS, a, a + ((payload[1] >> 22) & 63)))

        for shared, key, payload in LoserTree([decode(r) for r in rows]):
            if best is not None and shared == len(key) == len(now):
                if payload[:2] != best[:2]:  # else a row that stands twice
                    span(payload)  # equal keys come out in order of their payloads
            else:
                if best is not None:
                    groups.setdefault(best[2], []).append((now, best))
                best, now = payload, key
            if len(out) > 50_000:
                yield batch_of(out)
                out.clear()
        if best is not None:
            groups.setdefault(best[2], []).append((now, best))
        for members in groups.values():
            if len(members) > 1:
                windows(members, out)
                if len(out) > 50_000:
                    yield batch_of(out)
                    out.clear()
        yield batch_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:  # sorted by part: a partition of the exchange may hold several
            for row in batch.to_pylist():
                if rows and row["part"] != rows[0]["part"]:
                    yield from one(rows)
                    rows = []
                if row["part"] < 0:
                    ids, places = np.frombuffer(row["doc_id"], "<i8"), np.frombuffer(row["place"], "<i8")
                    first = places >> 28
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(places & _TEXT_BITS), pa.array(first), pa.array(first + ((places >> 22) & 63))], schema=schema)
                else:
                    rows.append(row)
        if rows:
            yield from one(rows)

    return runs.mapInArrow(run, _SPANS)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, parts: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: UTF-8 bytes under no string of ``length``
    bytes that also starts earlier (in a smaller id, or before in the same document).

    ``length`` is 64 to 111: places hold a window's and a gram's distance in six bits each.

    0. Texts that are whole copies of an earlier one are found by hash and removed whole.
    1. Sampling that loses nothing: each window of ``length`` bytes is stood for by its gram of least hash;
       windows whose gram stands at one place only repeat nowhere and go no further.
    2. The strings around the other grams are sorted within tasks, front-coded into runs, exchanged by gram,
       and merged with loser trees.  Equal strings: all but the earliest are removed whole.
    3. Different strings around one gram: their windows, aligned at the gram, are compared exactly.
    4. Removed windows meet their texts by id; bytes, not characters, are cut.

    Defined cases: a null text is empty; texts shorter than ``length`` stay; a null id sorts before all
    others; rows with equal id and text are one document and get one answer, those with equal id and other
    text are ordered by start, then by a hash of the text; an empty table gives an empty table; other columns are ignored.
    """
    if not GRAM + 16 <= length <= GRAM + 63:
        raise ValueError("length: 64 to 111")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 4 * n
    keyed = _keyed(docs, id_col, text_col)
    copies = materialize(_copies(keyed), "copies")
    # one exchange of texts serves both joins below; the filter, always true, is what the planner adds to one of them
    texts = _pressed(keyed).where("doc_id is not null and mark is not null").repartition(n, "doc_id", "mark")
    found = _anchor_rows(keyed, length).select("doc_id", F.col("place").bitwiseAND(_TEXT_BITS).alias("mark"), "gram", "place")
    by_doc = found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("place", "gram")).alias("x")).join(copies, ["doc_id", "mark"], "left_anti")
    once = texts.join(by_doc.select("doc_id", "mark", F.col("x.gram").alias("grams"), F.col("x.place").alias("places")), ["doc_id", "mark"]).select("doc_id", "data", "grams", "places")
    merged = _merge(_runs(once, parts, length).repartition("part").sortWithinPartitions("part"), length)
    whole_copies = copies.where(F.col("n") >= length).select("doc_id", "mark", F.lit(0).cast("long").alias("first"), (F.col("n") - length).alias("last"))
    spans = merged.unionByName(whole_copies).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("x")).select("doc_id", "mark", F.col("x.first").alias("firsts"), F.col("x.last").alias("lasts"))
    whole = texts.join(spans, ["doc_id", "mark"], "left").select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "data", "firsts", "lasts")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = []
                for data, firsts, lasts in zip(part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    data = press.decompress(data.as_buffer())
                    kept, at, gone, n = [], 0, 0, 0
                    if firsts:
                        end = -1
                        for a, b in sorted(zip(firsts, lasts, strict=True)):
                            b += length
                            if a > end:
                                n += 1
                                kept.append(data[at:a])
                                gone += b - a
                                at = end = b
                            elif b > end:
                                gone += b - end
                                at = end = b
                    kept.append(data[at:])
                    rows.append((len(data), gone, n, b"".join(kept)))
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, schema.types[1:], strict=True))], schema=schema)

    return whole.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
