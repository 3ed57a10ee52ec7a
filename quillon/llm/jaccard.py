"""N-gram Jaccard join with token-combination prefixes, and the groups its links make."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import binary_texts, components, materialize, repeated, small_side

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)
SKETCHES = 6


class _Hashes(dict):
    """64-bit hashes of words, each computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, size: int, memo: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words.

    A-Z is lower-cased; words are what ASCII white space parts.  A text of fewer words is one shingle;
    without words the set is empty.
    """
    words = text.translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.array([memo[w] for w in words], dtype=np.uint64)
    n = min(size, len(codes))
    h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ codes[k : k + len(h)]) * _MUL
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def most_missing(n: int, percent: int) -> int:
    """How many of its ``n`` tokens a set can lack in a set it is linked with."""
    return n - (percent * n + 99) // 100


def bands(n: int, percent: int) -> range:
    """Powers of two in which the larger of two linked sets can lie, if one of them has ``n`` tokens."""
    return range(n.bit_length() - 1, (100 * n // percent).bit_length())


def signatures(tokens: np.ndarray, heavy: np.ndarray, percent: int) -> np.ndarray:
    """What a set is indexed by: rare tokens of its prefix alone, frequent ones in pairs.

    Tokens are ordered rare ones first, frequent ones after, by hash within both classes.  A set may lack
    ``most_missing`` tokens of a linked one, so its prefix grows until it covers one more: each rare token
    covers 1, and the frequent tokens, dealt by hash into classes, cover one less than their number in
    each class, for of so many at least two of one class are shared.  The number of classes goes with
    the size of the larger set, so that pairs stay about as few as tokens; a set whose partner may be of
    the next power of two is indexed for both.
    """
    need = most_missing(len(tokens), percent) + 1
    if len(tokens) < 2:
        return np.zeros(0, dtype=np.uint64)  # links only with its copies
    frequent = np.zeros(len(tokens), dtype=bool)
    if len(heavy):
        frequent = heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens
    rare = tokens[~frequent][:need]
    out = [_mix(rare ^ np.uint64(0xA5A5A5A5))]
    left = need - len(rare)
    if left > 0:
        common = tokens[frequent]
        for band in bands(len(tokens), percent):
            classes = max(1, (1 << band) // 16)
            of = (_mix(common ^ np.uint64(0x3C3C)) % np.uint64(classes)).astype(np.int64)
            covered, sets = 0, {}
            for token, cls in zip(common, of, strict=True):
                covered += cls in sets
                sets.setdefault(cls, []).append(token)
                if covered >= left:
                    break
            salt = np.uint64(band + 1)
            for members in sets.values():
                if len(members) > 1:
                    i, j = map(np.array, zip(*combinations(range(len(members)), 2), strict=True))
                    values = np.array(members, dtype=np.uint64)
                    out.append(_mix(_mix(values[i] + salt) * _MUL ^ values[j]))
    return np.unique(np.concatenate(out))


def histogram(tokens: np.ndarray) -> bytes:
    """How many tokens have each first byte, as 256 bytes; 255 stands for that many or more."""
    return np.minimum(np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def possible(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sets with these histograms can be linked: each byte's tokens share the lesser count at most."""
    a, b = int(x.sum()), int(y.sum())
    most = int(np.minimum(x, y).sum())
    return 100 * most >= percent * (a + b - most) or bool((x == 255).any() or (y == 255).any())


def _summaries(docs: DataFrame, size: int, block: int = 1 << 20, local_min: int = 6) -> DataFrame:
    """A row a document (id, set size, fingerprint, sketches, histogram), and rows of tokens frequent within a task.

    Tokens are counted once for each first sketch in a task, so copies of one text do not make its
    tokens frequent.  Counts steer the order of tokens only; any order gives the same links.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("keys", pa.list_(pa.int64())), ("token", pa.int64()), ("times", pa.int64()), ("hist", pa.binary())])
    rng = np.random.default_rng(7)
    salts = rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, pool, pooled = _Hashes(), set(), [], 0

        def frequent() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(pool), return_counts=True) if pool else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            values, times = values[times >= local_min], times[times >= local_min]
            none = [None] * len(values)
            return pa.RecordBatch.from_arrays([pa.array(none, schema.types[0]), pa.array(none, schema.types[1]), pa.array(none, schema.types[2]), pa.array(none, schema.types[3]), pa.array(values.view(np.int64)), pa.array(times.astype(np.int64)), pa.array(none, schema.types[6])], schema=schema)

        for batch in batches:
            for part, texts in binary_texts(batch, "text"):
                n, fps, keys, hists = [], [], [], []
                for text in texts:
                    tokens = shingle_set(text, size, memo)
                    n.append(len(tokens))
                    hists.append(histogram(tokens))
                    fps.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                    own = [int(_mix(tokens ^ s).min().view(np.int64)) for s in salts] if len(tokens) else []
                    keys.append(own)
                    if own and own[0] not in seen:
                        seen.add(own[0])
                        pool.append(tokens)
                        pooled += len(tokens)
                        if pooled >= block:
                            yield frequent()
                            pool, pooled = [], 0
                            seen.clear()
                none = pa.array([None] * len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, schema.types[3]), none, none, pa.array(hists, pa.binary())], schema=schema)
        yield frequent()

    return docs.mapInArrow(run, "doc_id long, n long, fp binary, keys array<long>, token long, times long, hist binary")


def _crowded(entries: DataFrame, percent: int) -> DataFrame:
    """Possible pairs (a, b) of different groups among the entries of each signature that many share.

    ``entries``: (sig, doc_id, comp, n, hist).  A signature's entries stream by in order; their histograms
    (256 bytes each) are compared in memory, sizes first, and only pairs that may be linked come out.
    """

    def pairs(rows: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        table = pa.Table.from_batches(rows)
        ids, comp, n = (table.column(k).to_numpy() for k in (1, 2, 3))
        order = np.argsort(n, kind="stable")
        ids, comp, n = ids[order], comp[order], n[order]
        hist = np.frombuffer(b"".join(table.column(4).to_pylist()), dtype=np.uint8).reshape(-1, 256)[order]
        full = (hist == 255).any(axis=1)
        last = np.searchsorted(n, 100 * n // percent, "right")
        for k in range(len(n)):
            for start in range(k + 1, last[k], 4096):
                at = np.arange(start, min(start + 4096, last[k]))
                at = at[comp[at] != comp[k]]
                if len(at):
                    most = np.minimum(hist[at], hist[k]).sum(axis=1, dtype=np.int64)
                    at = at[(100 * most >= percent * (n[k] + n[at] - most)) | full[at] | full[k]]
                    if len(at):
                        yield np.minimum(ids[at], ids[k]), np.maximum(ids[at], ids[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(sigs[1:] != sigs[:-1]) + 1), len(sigs)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if group and group[0].column(0)[0].as_py() != int(sigs[a]):
                    for x, y in pairs(group):
                        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
                    group = []
                group.append(batch.slice(a, b - a))
        if group:
            for x, y in pairs(group):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return entries.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            for part, texts in binary_texts(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, size, memo).tobytes() for t in texts], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "id long, tokens binary")


def verify(docs: DataFrame, pairs: DataFrame, hists: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked.

    Histograms (id, hist) rule out nearly all pairs that are not: no linked pair fails that test.  Sets are
    made again, for the documents of the other pairs only.
    """
    pairs = pairs.join(hists.select(F.col("id").alias("a"), F.col("hist").alias("hist_a")), "a").join(hists.select(F.col("id").alias("b"), F.col("hist").alias("hist_b")), "b")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [possible(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs.select("a", "b", "hist_a", "hist_b").mapInArrow(screen, "a long, b long"), "screened")
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "involved")
    sets = _sets(docs.join(small_side(ids), "doc_id", "left_semi"), size)
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long").distinct()


def similarity_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    heavy_min: int = 20,
    max_heavy: int = 100_000,
    crowd: int = 64,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: groups that links of ``percent`` / 100 Jaccard make.

    1. One pass gives each document's set size, fingerprint and sketches; copies of a set become one class.
    2. Classes that share sketches with the smallest id of a sketch are verified against it (one candidate
       a class and sketch): this joins large groups of near copies by stars, without all their pairs.
    3. A second pass indexes prefixes (see ``signatures``, whose ``heavy`` is sorted).  Only index entries of different groups so far
       meet, so that no pair within a group is made and every link between groups is.  Sizes are compared
       first, then histograms of the sets; whole sets are verified.  Where more than ``crowd`` entries share a
       signature, histograms are compared before any pair is made.
    4. Groups come from alternating star rounds.  Only counts and the tokens counted as frequent (at most
       ``max_heavy``) reach the driver.

    Defined cases: null and wordless texts have an empty set and link with nothing; a text shorter than a
    shingle is one shingle; rows that repeat an id are one node; a row with a null id links with nothing
    and has a null component; an empty table gives an empty table; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(_summaries(docs, size), "summaries")
    own = rows.where("fp is not null").select("doc_id", "n", "fp", "keys", "hist")
    nodes = own.where("doc_id is not null and n > 0")
    classes = nodes.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys"), F.any_value("n").alias("n"), F.any_value("hist").alias("hist"))
    classes = materialize(classes, "classes")
    hists = classes.select(F.col("rep").alias("id"), "hist")
    # stars around the smallest id of each sketch
    keyed = classes.select("rep", "n", F.posexplode("keys").alias("k", "key"))
    leaders = keyed.groupBy("k", "key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("many")).where("many > 1")
    stars = (
        keyed.join(leaders, ["k", "key"]).where("rep <> leader").groupBy(F.col("leader").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("agree"))
        .where(F.col("agree") >= SKETCHES // 2).select("a", "b")
    )
    first = components(verify(docs, stars, hists, size, percent))
    first = materialize(first, "first")
    groups = classes.select("rep", "n", "fp").join(first.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("rep", "n", "fp", F.coalesce("comp", "rep").alias("comp"))
    groups = materialize(groups, "groups")
    # frequent tokens, a bounded number
    heavy = rows.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= heavy_min).orderBy(F.desc("times"), "token").limit(max_heavy).select("token")
    shipped = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.token for r in heavy.collect()], dtype=np.int64).view(np.uint64)))
    schema = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            for part, texts in binary_texts(batch, "text"):
                found = [signatures(shingle_set(t, size, memo), shipped.value, percent) for t in texts]
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)), pa.array(ids.astype(np.int64))], schema=schema)

    entries = repeated(docs.where("doc_id is not null").mapInArrow(index, "sig long, doc_id long"), "sig")
    shared = materialize(entries, "entries").join(groups.select(F.col("rep").alias("doc_id"), "comp", "n"), "doc_id")
    several = shared.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("many")).where("low <> high").select("sig", "many")
    every = materialize(shared.join(several, "sig"), "mixed")
    crowded = every.where(F.col("many") > crowd).join(hists.select(F.col("id").alias("doc_id"), "hist"), "doc_id").select("sig", "doc_id", "comp", "n", "hist")
    mixed = every.where(F.col("many") <= crowd)
    left = mixed.select("sig", F.col("doc_id").alias("a"), F.col("comp").alias("comp_a"), F.col("n").alias("n_a"))
    right = mixed.select("sig", F.col("doc_id").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"))
    sized = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.col("comp_a") < F.col("comp_b"))
    pairs = left.join(right, "sig").where(sized).select("a", "b").unionByName(_crowded(crowded, percent)).distinct()
    links = verify(docs, pairs, hists, size, percent)
    of = groups.select("rep", "comp")
    over = links.join(of.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a").join(of.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    last = components(over).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    final = groups.join(last, "comp", "left").select("fp", F.coalesce("root", "comp").alias("component_id"))
    linked = nodes.select("doc_id", "fp").join(final, "fp").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = own.select("doc_id", F.col("n").alias("n_shingles")).join(materialize(linked, "linked"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
