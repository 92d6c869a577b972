"""Large JSON containers read in parts: an array of records, or an object whose values are records.

A whole file in one cell would be read by one task. Here the text reader cuts files at
closing braces, so Spark splits a file of any size over many tasks; each fragment then
is one record, if records hold no objects and no string holds a brace. That is checked
for every fragment, with strings and escapes taken out. Files of another shape are found
by that check and read whole, which is exact for any JSON but does not split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A JSON string, and what may stand before a record in an object and in an array.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
KEYED = rf"^[\s,]*\{{?\s*({STRING})\s*:\s*\{{"
LISTED = r"^[\s,]*\[?\s*\{"


def _fragments(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, value, keyed, rest, plain): text between closing braces, and whether it is one record."""
    text = spark.read.option("lineSep", "}").text(pattern).select(F.col("_metadata.file_path").alias("file"), "value")
    bare = F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), r'"[^"]*"', "")
    opened = F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))
    keyed, listed = F.col("value").rlike(KEYED), F.col("value").rlike(LISTED)
    # An object's own brace stands at the beginning of the file only, before the first key.
    begins = F.col("value").rlike(r"^\s*\{")
    rest = (opened == 0) & F.trim(F.translate(bare, "\n\r\t", "   ")).isin("", "]", ",")
    record = ((opened == 1) & ~begins & (keyed | listed)) | ((opened == 2) & keyed & begins)
    return text.select("file", "value", keyed.alias("keyed"), rest.alias("rest"), (~bare.contains('"') & (record | rest)).alias("plain"))


def read_records(spark: SparkSession, pattern: str, record: T.StructType) -> DataFrame:
    """(file, key, r): one row per record; ``key`` is null in arrays. Null and empty containers give no rows."""
    found = _fragments(spark, pattern)
    odd = found.where("NOT plain").select("file").distinct()
    rows = found.where("plain AND NOT rest")
    none = odd.isEmpty()
    if not none:
        rows = rows.join(odd, "file", "left_anti")
    body = F.concat(F.regexp_replace("value", F.when(F.col("keyed"), F.lit(KEYED)).otherwise(F.lit(LISTED)), F.lit("{")), F.lit("}"))
    key = F.from_json(F.concat(F.lit("["), F.regexp_extract("value", KEYED, 1), F.lit("]")), "array<string>")[0]
    split = rows.select("file", F.when(F.col("keyed"), key).alias("key"), F.from_json(body, record).alias("r"))
    if none:
        return split
    whole = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").join(odd, "file", "left_semi")
    is_array = F.ltrim(F.translate("value", "\n\r\t", "   ")).startswith("[")
    arrays = whole.where(is_array).select("file", F.lit(None).cast("string").alias("key"), F.explode(F.from_json("value", T.ArrayType(record))).alias("r"))
    objects = whole.where(~is_array).select("file", F.explode(F.from_json("value", T.MapType(T.StringType(), record))).alias("key", "r"))
    return split.unionByName(arrays).unionByName(objects)
