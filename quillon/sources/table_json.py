"""JSON forms of tables and of keyed values; Parquet point tables are the usual store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE = "struct<table:map<string,map<string,double>>,x_step:double,y_step:double,x_mode:string,y_mode:string,clamp:boolean>"
VALUES = "struct<replace:boolean,values:map<string,double>>"


def decode_tables(docs: DataFrame, *, fn_id: str = "fn_id", json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(points, meta) of JSON tables; documents that cannot be read, or lack a table or clamp, are left out."""
    parsed = docs.select(F.col(fn_id).alias("fn_id"), F.from_json(json, TABLE, {"mode": "PERMISSIVE"}).alias("t")).where("t.table is not null and t.clamp is not null")
    rows = parsed.select("fn_id", F.explode("t.table").alias("x", "row"))
    points = rows.select("fn_id", F.col("x").cast("double").alias("x"), F.explode("row").alias("y", "v")).select("fn_id", "x", F.col("y").cast("double").alias("y"), "v")
    return points, parsed.select("fn_id", "t.x_step", "t.y_step", "t.x_mode", "t.y_mode", "t.clamp")


def encode_tables(points: DataFrame, meta: DataFrame) -> DataFrame:
    """(fn_id, json): keys as text, rows and cells in order of their numbers."""
    pairs = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda e: F.struct(e["k"].cast("string").alias("key"), e["v"].alias("value")))
    rows = points.groupBy("fn_id", "x").agg(pairs("y", F.col("v")).alias("cells"))
    # maps have no order of their own to sort by: a row's cells stay an array until all rows are in order
    tables = rows.groupBy("fn_id").agg(pairs("x", F.col("cells")).alias("rows"))
    table = F.map_from_entries(F.transform("rows", lambda r: F.struct(r["key"].alias("key"), F.map_from_entries(r["value"]).alias("value"))))
    return tables.select("fn_id", table.alias("table")).join(meta, "fn_id").select("fn_id", F.to_json(F.struct("table", *[c for c in meta.columns if c != "fn_id"])).alias("json"))


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tables of all JSON files below a folder, and of what ``write_tables`` wrote there.

    A table's fn_id is the file's name without folder and ending, or the name of its ``fn_id=`` folder.
    """
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{json,txt}").select(plain(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("json"))
    folder = F.regexp_extract("file", r"/fn_id=([^/]+)/[^/]+\.txt$", 1)
    own = F.when(folder != "", plain(folder)).otherwise(F.regexp_extract("file", r"([^/]+)\.json$", 1))
    return decode_tables(files.select(own.alias("fn_id"), "json").where("fn_id <> ''"))


def write_tables(points: DataFrame, meta: DataFrame, path: str) -> None:
    """One line of JSON a table, in a folder for each fn_id; ``read_tables`` reads them back."""
    encode_tables(points, meta).select("fn_id", F.col("json").alias("value")).write.partitionBy("fn_id").mode("overwrite").text(path)


def decode_values(docs: DataFrame, *, json: str = "json") -> DataFrame:
    """(key, is_tag, value, replace) of keyed values; a leading # marks a tag."""
    parsed = docs.select(F.from_json(json, VALUES).alias("m")).where("m.values is not null")
    rows = parsed.select(F.coalesce("m.replace", F.lit(False)).alias("replace"), F.explode("m.values").alias("k", "value"))
    return rows.select(F.regexp_replace("k", "^#", "").alias("key"), F.col("k").startswith("#").alias("is_tag"), "value", "replace")


def axis_key(value: Column) -> Column:
    """The text of a number as a map key."""
    return value.cast("double").cast("string")
