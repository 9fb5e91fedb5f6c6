"""Alias dimension: abbreviated names, their formal names and who holds the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "abbr string, formal string, law_id string, law_num string, domain string, category string, owner string"
OWNER = "statutes"

#: A seed of well-known abbreviations; a deployment passes its own table of the same columns.
ROWS = [
    ("消法", "消費税法", "363AC0000000108", "昭和六十三年法律第百八号", "tax", "law", OWNER),
    ("所法", "所得税法", "340AC0000000033", "昭和四十年法律第三十三号", "tax", "law", OWNER),
    ("法法", "法人税法", "340AC0000000034", "昭和四十年法律第三十四号", "tax", "law", OWNER),
    ("労基", "労働基準法", "322AC0000000049", "昭和二十二年法律第四十九号", "labor", "law", OWNER),
    ("労基法", "労働基準法", "322AC0000000049", "昭和二十二年法律第四十九号", "labor", "law", OWNER),
    ("個情法", "個人情報の保護に関する法律", "415AC0000000057", "平成十五年法律第五十七号", "privacy", "law", OWNER),
    ("所基通", "所得税基本通達", None, None, "tax", "circular", "circulars"),
]


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)
