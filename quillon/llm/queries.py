"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate as clean
from quillon.llm import html_text, jaccard, langid, licenses, line_dedup, packing, quality, suffix_dedup, toxicity
from quillon.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rules = quality.fit(docs, _read(spark, sf_dir, "labels"))
    judged = quality.judge(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_groups(_read(spark, sf_dir, "documents"), size=4, percent=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels.where(fold("doc_id", 3) != 1))
    scored = toxicity.score(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_matches")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = _read(spark, sf_dir, "documents"), licenses.known_digests(spark)
    whole = licenses.scan_licenses(docs, known)
    notices = licenses.scan_notices(docs, known).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    return whole.join(notices, "doc_id", "left").select("doc_id", "digest", "license_id", "n_canonical", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), "notices")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path(), capacity=1024, end_id=2)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean.find_overlap(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda s, x: F.struct((s.sum + s.sign * x).alias("sum"), (-s.sign).alias("sign")), lambda s: s.sum)
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_ngram_jaccard_join, op3_toxicity, op4_license_scan, op5_best_fit_packing, op6_benchmark_decontamination, op7_html_extraction, op8_language_id, op9_line_dedup, op10_suffix_array_dedup)
}


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{licenses._COPYRIGHT_LINE}', ' ', 'g')"
    out = rf"' ' || regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' '"
    for had, kept in licenses.SPELLINGS:
        out = f"replace({out}, ' {had} ', ' {kept} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP_CTES = f"""
ql_lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM {{docs}}
), ql_keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_SPACES}), {_UP}) AS k FROM ql_lines
), ql_shared AS (
  SELECT k, max(doc_id) AS keeper FROM ql_keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), ql_flagged AS (
  SELECT a.*, s.k IS NOT NULL AND a.doc_id <> s.keeper AS gone FROM ql_keyed a LEFT JOIN ql_shared s ON a.k = s.k
), ql_kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM ql_flagged GROUP BY doc_id
)"""

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE [w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] FOR i IN range(1, len(w) - 2)] END) AS s FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), rare AS (SELECT s FROM shingles GROUP BY s HAVING count(*) > 1
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN rare USING (s) JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.root AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) c ON c.node = d.doc_id
""",
    "op4_license_scan": f"""
WITH known AS (
  SELECT sha256({_canonical_sql("t")}) AS digest, min(license_id) AS license_id, min(kind) AS kind
  FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)}, {_quoted(c)})" for a, b, c in licenses.KNOWN)}) v(license_id, kind, t) GROUP BY 1
), whole AS (
  SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS c FROM documents
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
), notices AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
  FROM lines JOIN known ON sha256({_canonical_sql("line")}) = digest AND kind = 'notice' GROUP BY doc_id
)
SELECT w.doc_id, sha256(w.c) AS digest, k.license_id, length(w.c) AS n_canonical, coalesce(n.n, 0) AS n_notices, n.ids AS notices
FROM whole w LEFT JOIN known k ON sha256(w.c) = k.digest LEFT JOIN notices n ON n.doc_id = w.doc_id
""",
    "op6_benchmark_decontamination": """
WITH folded AS (
  SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), windows AS (
  SELECT DISTINCT id AS item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+9], ' ') FOR i IN range(1, len(w) - 8)] END) AS win,
    least(len(w), 10) AS k
  FROM folded WHERE side = 'b'
), sizes AS (SELECT DISTINCT k FROM windows
), grams AS (
  SELECT f.id, s.k, unnest(range(1, len(w) - s.k + 2)) AS pos, unnest([array_to_string(w[i:i+s.k-1], ' ') FOR i IN range(1, len(w) - s.k + 2)]) AS win
  FROM folded f, sizes s WHERE f.side = 'd' AND len(w) >= s.k
), hits AS (
  SELECT g.id, g.pos, g.k, x.item_id FROM grams g JOIN windows x ON x.win = g.win AND x.k = g.k
), covered AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(pos, pos + k)) AS p FROM hits) GROUP BY id
), found AS (
  SELECT id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY id
)
SELECT CAST(f.id AS BIGINT) AS doc_id, len(f.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN covered c ON c.id = f.id LEFT JOIN found i ON i.id = f.id WHERE f.side = 'd'
""",
    "op9_line_dedup": f"WITH {LINE_DEDUP_CTES.format(docs='documents')} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM ql_kept",
    "op10_suffix_array_dedup": """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM bytes WHERE n >= 100)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1
), starts AS (
  SELECT doc_id, p, sum(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS grp
  FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) AS before FROM later)
), spans AS (
  SELECT doc_id, grp, min(p) AS a, max(p) + 100 AS b FROM starts GROUP BY doc_id, grp
), removed AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM spans GROUP BY doc_id
), pieces AS (
  SELECT doc_id, a AS cut_from, b AS next_from, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS keep_from FROM spans
), kept AS (
  SELECT x.doc_id, string_agg(substr(b.h, 2 * keep_from + 1, 2 * (cut_from - keep_from)), '' ORDER BY keep_from) || substr(any_value(b.h), 2 * max(next_from) + 1) AS h
  FROM pieces x JOIN bytes b ON b.doc_id = x.doc_id GROUP BY x.doc_id
)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, coalesce(r.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.h, b.h))) AS kept_sha256
FROM bytes b LEFT JOIN removed r ON r.doc_id = b.doc_id LEFT JOIN kept k ON k.doc_id = b.doc_id
""",
}
