"""JSON-lines corpus scans (A1 tolerant, A2 strict) and the required-field
check (B1, B12).

Tolerant scan: every line is parsed with ``try_parse_json``, and a line that
this refuses once more by the permissive JSON reader, which takes repeated keys
(the last one counts) and NaN or infinite numbers. A line is rejected as
``malformed`` when neither parses it (keys repeated within the value of a
required field included), ``not an object`` when it is valid JSON of another
kind, and ``missing field <f>`` when one of ``url, date, title, summary, text``
is absent. A present field whose value is null or not a string becomes ``""``.
Good rows get ``doc_id``, an increasing id in file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
REQUIRED_FIELDS = ("url", "date", "title", "summary", "text")
# --- end of fixed values ----------------------------------------------------

RAW_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in REQUIRED_FIELDS])


# The second reading of a line: fields as variants, null where absent.
_LOOSE = ", ".join(f"{f} variant" for f in REQUIRED_FIELDS) + ", _bad string"
_LOOSE_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad",
                  "allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}


def _string(item):
    is_string = F.schema_of_variant(item) == F.lit("STRING")
    return F.when(is_string, F.try_variant_get(item, "$", "string")).otherwise(F.lit(""))


def _string_field(v, loose, name: str):
    first = _string(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.when(v.isNotNull(), first).otherwise(_string(loose[name]))


def classify_lines(lines: DataFrame) -> DataFrame:
    """``(line_id, value, reason, url, date, title, summary, text)``;
    ``reason`` is null for good rows."""
    read = lines.select("value", F.try_parse_json("value").alias("_v")).select(
        "value", "_v", F.when(F.col("_v").isNull(), F.from_json("value", _LOOSE, _LOOSE_OPTIONS))
        .alias("_loose"))
    v, loose, keys = F.col("_v"), F.col("_loose"), F.json_object_keys("value")
    neither = v.isNull() & (loose.isNull() | loose["_bad"].isNotNull())
    reason = (F.when(neither, F.lit("malformed"))
              .when(~F.schema_of_variant(v).startswith("OBJECT"), F.lit("not an object")))
    for field in REQUIRED_FIELDS:
        absent = F.when(v.isNotNull(), ~F.array_contains(keys, F.lit(field))).otherwise(
            loose[field].isNull())
        reason = reason.when(absent, F.lit(f"missing field {field}"))
    return read.select(
        F.monotonically_increasing_id().alias("line_id"), "value",
        reason.alias("reason"),
        *[_string_field(v, loose, f).alias(f) for f in REQUIRED_FIELDS])


def read_jsonl_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1: ``(good, rejects)``. ``good`` has ``doc_id`` plus the five string
    fields; ``rejects`` has ``line_id, value, reason``."""
    classified = classify_lines(spark.read.text(path))
    good = classified.where(F.col("reason").isNull()).select(
        F.col("line_id").alias("doc_id"), *REQUIRED_FIELDS)
    rejects = classified.where(F.col("reason").isNotNull()).select("line_id", "value", "reason")
    return good, rejects


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """A2: any malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
