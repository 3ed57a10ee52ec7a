"""Best-fit packing of token pieces into sequences of a fixed capacity."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize


class OpenBins:
    """Segment tree over remaining capacities: which of them some open bin has.

    A leaf stands for a capacity and holds the intervals of sequence numbers whose bins have just that
    much left; ``tightest`` finds the least capacity that fits in logarithmic time.
    """

    def __init__(self, capacity: int) -> None:
        self.size = 1 << max(1, (capacity + 1).bit_length())
        self.has = np.zeros(2 * self.size, dtype=bool)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def put(self, left: int, start: int, count: int) -> None:
        if left <= 0 or count <= 0:
            return
        self.bins.setdefault(left, []).append((start, count))
        at = left + self.size
        while at and not self.has[at]:
            self.has[at] = True
            at //= 2

    def take(self, left: int) -> tuple[int, int]:
        got = self.bins[left].pop()
        if not self.bins[left]:
            del self.bins[left]
            at = left + self.size
            self.has[at] = False
            while at > 1 and not self.has[at ^ 1]:
                at //= 2
                self.has[at] = False
        return got

    def tightest(self, need: int) -> int | None:
        at = need + self.size
        while not self.has[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at //= 2
            if at <= 1:
                return None
            at += 1
        while at < self.size:
            at = 2 * at + (0 if self.has[2 * at] else 1)
        return at - self.size


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over all pieces, given how many there are of each length.

    Pieces of one length are alike, so the classic run that takes one piece at a time is followed for
    whole groups of equal bins at once.  Returns rows (length, first rank, pieces a bin, first sequence,
    first offset, ranks) in order of length and rank, and the number of sequences.
    """
    tree, rows, sequences = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, bins, start = capacity, -(-todo // (capacity // length)), sequences
                sequences += bins
            else:
                start, bins = tree.take(left)
            each = left // length
            full = min(bins, todo // each)
            if full:
                rows.append((length, rank, each, start, capacity - left, full * each))
                tree.put(left - each * length, start, full)
                rank, todo, start, bins = rank + full * each, todo - full * each, start + full, bins - full
            if bins and todo:
                some = min(todo, each)
                rows.append((length, rank, each, start, capacity - left, some))
                tree.put(left - some * length, start, 1)
                rank, todo, start, bins = rank + some, todo - some, start + 1, bins - 1
            tree.put(left, start, bins)
    return np.array(rows, dtype=np.int64).reshape(-1, 6), sequences


#: Code points for which both tokenizer libraries split words alike; other texts take the plain way.
_COMMON = re.compile("[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞€]*")


def _ranked_bytes(spec: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE, split by the usual pattern, with ids in the order of its merges."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or spec.get("truncation"):
        return False
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"].get(x, -1) for x in merged]
    added = {x["content"] for x in spec.get("added_tokens", [])}
    rest = [x for x in model["vocab"].keys() - set(merged) if x not in added]
    return len(rest) == 256 and all(len(x) == 1 for x in rest) and all(x < y for x, y in zip([max(model["vocab"][x] for x in rest), *ids], ids))


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A function from texts to id lists, equal to ``tokenizers`` on the file at ``path``.

    Where the file is a byte-level BPE whose ids are merge ranks, the faster BPE engine reads them; texts with an
    added token's string or rarer code points, and all texts of other files, go through ``tokenizers`` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    @lru_cache(maxsize=1)
    def plain() -> Tokenizer:  # loaded only where a text needs it
        return Tokenizer.from_file(path)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _ranked_bytes(spec):
        return lambda text: plain().encode(text, add_special_tokens=False).ids
    added = [x["content"] for x in spec.get("added_tokens", [])]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in added}
    ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("same-vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if _COMMON.fullmatch(text) and not any(x in text for x in added):
            return fast.encode_ordinary(text)
        return plain().encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def tokenize_pieces(docs: DataFrame, *, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, with their number among the task's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("nth", pa.int64())])
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes()), task, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, *, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents, token ids and an end id each, into as few sequences as best-fit decreasing needs.

    The whole corpus is packed as one: tasks tokenize and write their pieces (never ids) to the shared
    folder, the driver gets one count a length (``capacity`` of them at most) and plans the bins with a
    segment tree, and each piece finds its place from its rank among the pieces of its length: a running
    sum of task counts plus its number in the task.  No document, and no list of documents, is gathered.

    Defined cases: a null text is empty and packs as its end id; every row is packed, repeated rows and
    null ids too; an empty table gives an empty table; other columns are ignored.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer_path=tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_bins(counts, capacity)
    shipped = docs.sparkSession.sparkContext.broadcast(plan)
    # the first rank of each task: a running sum over tasks, of the few rows that counts by task are
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    firsts = by_task.select(F.col("length"), F.col("task"), F.coalesce(before, F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shipped.value
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows = rows[order]
        lengths = np.unique(rows[:, 0])
        bounds = {int(n): (np.searchsorted(rows[:, 0], n), np.searchsorted(rows[:, 0], n, "right")) for n in lengths}
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                a, b = bounds[int(n)]
                here = np.flatnonzero(length == n)
                row[here] = a + np.searchsorted(rows[a:b, 1], rank[here], "right") - 1
            own = rows[row]
            inside = rank - own[:, 1]
            sequence = own[:, 3] + inside // own[:, 2]
            offset = own[:, 4] + (inside % own[:, 2]) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
