"""Query-set sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# The ten evaluation queries of the ranked-retrieval design, with their
# descriptions, in source order.
REFERENCE_QUERIES = (
    ("экономика", "Однословный базовый запрос"),
    ("искусственный интеллект", "Устойчивое словосочетание"),
    ("новости про газпром", "Запрос с упоминанием компании"),
    ("отношения россии и китая", "Тематический запрос с упоминанием стран"),
    ("влияние санкций на экономику россии 2020",
     "Сложный аналитический запрос с временным контекстом"),
    ("цены на недвижимость в москве рост", "Запрос с географической привязкой и уточнением"),
    ("новые технологии в медицине 2020", "Общий тематический запрос с временным контекстом"),
    ("как изменился курс рубля", "Запрос в форме вопроса"),
    ("российская военная операция", "Новостной тематический запрос"),
    ("развитие зеленой энергетики", "Запрос по развивающейся тематике"),
)
# --- end of fixed values ----------------------------------------------------


def reference_queries(spark: SparkSession) -> DataFrame:
    """The fixed evaluation query set ``(query_id, query, description)``."""
    rows = [(i, q, d) for i, (q, d) in enumerate(REFERENCE_QUERIES)]
    return spark.createDataFrame(rows, "query_id long, query string, description string")


def read_query_lines(spark: SparkSession, path: str) -> DataFrame:
    """One query per line, trimmed, blank lines dropped; ``query_id`` is
    increasing in file order."""
    lines = spark.read.text(path).select(F.trim("value").alias("query"))
    return lines.where(F.col("query") != "").select(
        F.monotonically_increasing_id().alias("query_id"), "query",
        F.lit("").alias("description"))
