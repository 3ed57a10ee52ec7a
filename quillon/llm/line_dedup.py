"""Line dedup: drop long lines that many documents share, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, UPPER, free_names, materialize, named

_BLANK = " \t\n\x0b\x0c\r"
#: Keys that hold one line in so many or more are hot; there can be no more of them than this.
HOT_SHARE = 100_000


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), UPPER, LOWER)


def _dealt(rows: DataFrame) -> DataFrame:
    """A row that has met its hot key gets another hash for the join that follows, so that no key's rows land in one task."""
    return rows.withColumn("d1", F.when(F.col("is_hot"), F.xxhash64("id", "th", "at")).otherwise(F.col("h1")))


def _meet(rows: DataFrame, keys: DataFrame, least: int) -> DataFrame:
    """The ``rows`` whose key (h1, h2) is among ``keys``, with its ``keeper`` and whether it is hot.

    Keys of ``least`` lines or more are broadcast (``HOT_SHARE`` bounds their number) and never shuffled;
    the others, none of which has many rows, are joined by whatever plan their size asks for.
    """
    hot = keys.where(F.col("n_key") >= least).select("h1", "h2", F.col("keeper").alias("hot_keeper"), F.lit(True).alias("is_hot"))
    cold = keys.where(F.col("n_key") < least).select(F.col("h1").alias("d1"), "h2", "keeper", F.lit(True).alias("is_cold"))
    met = _dealt(rows.join(F.broadcast(hot), ["h1", "h2"], "left")).join(cold, ["d1", "h2"], "left").where(F.col("is_hot") | F.col("is_cold"))
    return met.select("id", "th", "at", "h1", "h2", F.when(F.col("is_hot"), F.col("hot_keeper")).otherwise(F.col("keeper")).alias("keeper"), F.coalesce("is_hot", F.lit(False)).alias("is_hot"))


def _without(met: DataFrame, few: DataFrame, least: int) -> DataFrame:
    """``met`` without the keys of ``few``, joined in the same two ways."""
    hot = few.where(F.col("n_key") >= least).select("h1", "h2")
    cold = few.where(F.col("n_key") < least).select(F.col("h1").alias("d1"), "h2")
    return _dealt(met.join(F.broadcast(hot), ["h1", "h2"], "left_anti")).join(cold, ["d1", "h2"], "left_anti")


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    keep_last: bool = True,
    hot_lines: int = 1000,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """Drop every line whose key has ``min_chars`` code points or more and stands in ``min_docs`` documents or more.

    Returns all columns of ``docs``, with the text replaced by the kept lines, and
    ``n_lines``, ``n_dropped``.  With ``keep_last`` the largest id holding a key keeps its lines.

    1. Lines are exploded as 128-bit key hashes (two salted 64-bit hashes), never as text.  Lines a key are
       counted by a plain aggregate with map-side combine: one key that a third of the rows hold costs one
       row a task.  Keys of fewer lines than ``min_docs``, or of one document, go no further.
    2. Lines of the other keys meet them.  A key of ``hot_lines`` lines or more, and of more than one line
       in ``HOT_SHARE``, is met by broadcast (there are at most ``HOT_SHARE`` such keys), so neither a key in
       many documents nor one that stands very often in few sends its rows to one task.
    3. Distinct documents are counted for each key that was met; keys of too few of them drop nothing.
    4. Texts are shuffled once, to meet their own dropped positions, and are put together again by position
       in one pass over their lines.

    Defined cases: a null text is one empty line and gives an empty text; rows that repeat an id are one
    document for the count, those that repeat its text too share one decision, and each comes back; rows
    without an id are one document, before all others; an empty table gives an empty table; other
    columns are kept whatever their names, but for those named as ``counts`` (in any case of letters), which are replaced.
    """
    own_text, own_id, own_th, own_drop = free_names(docs, "text", "id", "th", "drop")
    text = F.coalesce(named(text_col), F.lit(""))
    base = docs.select(named(id_col).alias("id"), text.alias("text"))
    keys = F.transform(
        F.split("text", "\n", -1),
        lambda line: F.when(F.length(line) >= min_chars, line_key(line)),
    )
    hashed = F.transform(
        keys,
        lambda key, at: F.when(
            F.length(key) >= min_chars,
            F.struct(at.cast("int").alias("at"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x51ED), key).alias("h2")),
        ),
    )
    placed = base.select("id", F.xxhash64("text").alias("th"), F.explode(F.filter(hashed, lambda x: x.isNotNull())).alias("x")).select("id", "th", "x.at", "x.h1", "x.h2")
    several = F.lit(True) if min_docs < 2 else (F.min("id") < F.max("id")) | (F.count("id") < F.count(F.lit(1)))
    shared = placed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_key"), F.max("id").alias("keeper"), several.alias("several"))
    shared = materialize(shared.where((F.col("n_key") >= min_docs) & F.col("several")).drop("several"), "shared-lines")
    least = max(hot_lines, (shared.agg(F.sum("n_key")).first()[0] or 0) // HOT_SHARE + 1)
    met = materialize(_meet(placed, shared, least), "met-lines")
    # a null id counts as a document too
    once = met.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("m"))
    few = materialize(once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("m").alias("n_key")).where(F.col("n_docs") < min_docs).select("h1", "h2", "n_key"), "few-lines")
    met = _without(met, few, least)
    if keep_last:
        met = met.where(~F.col("id").eqNullSafe(F.col("keeper")))
    drops = met.groupBy("id", "th").agg(F.collect_set("at").alias(own_drop)).select(F.col("id").alias(own_id), F.col("th").alias(own_th), own_drop)
    whole = docs.withColumn(own_text, text)
    joined = whole.join(drops, named(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(own_text) == F.col(own_th)), "left")
    split = F.split(own_text, "\n", -1)
    # the lines are bound once, as the only element of an array; a lambda that split again would do so for each line
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own_drop)), lambda at: F.element_at(lines, at + 1))
    rest = F.element_at(F.transform(F.array(split), lambda lines: F.array_join(stay(lines), "\n")), 1)
    kept = F.when(F.col(own_drop).isNull(), F.col(own_text)).otherwise(rest)
    out = {text_col: kept, counts[0]: F.size(split).cast("long"), counts[1]: F.coalesce(F.size(own_drop), F.lit(0)).cast("long")}
    names = [named(c) for c in docs.columns if c.lower() not in {k.lower() for k in out}]
    return joined.select(*names, *(v.alias(k) for k, v in out.items()))
