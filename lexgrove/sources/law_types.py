"""Kinds of legal acts: a built-in dimension of ten rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "ord int, name string, aliases array<string>, law_type_code string, enacting_body string, hierarchy_rank int, level string, binds_citizens boolean, "
    "can_set_penalties boolean, description string, examples array<string>, sources array<struct<label string, url string>>, notes array<string>"
)

#: Where texts of a kind are found, with an address or none.
STATUTES = ("e-Gov 法令検索", "https://laws.e-gov.go.jp/")
AGENCIES = ("各省庁ウェブサイト", "")
SOURCES = {
    "憲法": [("e-Gov 法令検索", "https://laws.e-gov.go.jp/law/321CONSTITUTION")],
    "法律": [STATUTES],
    "政令": [STATUTES],
    "省令": [STATUTES],
    "規則": [STATUTES, ("各自治体例規集", "")],
    "条例": [("各自治体の例規集（自治体ウェブサイト）", "")],
    "告示": [("官報（インターネット版）", "https://kanpou.npb.go.jp/"), ("e-Gov（一部の告示）", "https://laws.e-gov.go.jp/"), AGENCIES],
    "訓令": [AGENCIES],
    "通達": [("国税庁ウェブサイト", "https://www.nta.go.jp/law/tsutatsu/"), ("厚生労働省 法令等データベース", "https://www.mhlw.go.jp/hourei_db/"), ("安全衛生情報センター（JAISH）", "https://www.jaish.gr.jp/")],
    "通知": [AGENCIES],
}

#: Names, aliases, codes and ranks. The descriptions are our own.
ROWS = [
    (0, "憲法", ["日本国憲法"], None, "国民", 1, "national", True, False, "The supreme law; every other act must conform to it.", ["日本国憲法"], None),
    (1, "法律", None, "Act", "国会", 2, "national", True, True, "A statute of the legislature; penalties need one as their basis.", ["民法"], None),
    (2, "政令", ["施行令", "CabinetOrder"], "CabinetOrder", "内閣", 3, "national", True, True, "An order of the cabinet that carries out or is delegated by a statute.", ["消費税法施行令"], ["Void beyond what the statute delegates."]),
    (3, "省令", ["府令", "内閣府令", "施行規則", "MinisterialOrdinance"], "MinisterialOrdinance", "各省大臣", 4, "national", True, True, "A minister's ordinance with technical detail.", ["消費税法施行規則"], ["What a system must do in detail mostly stands here.", "That of the Cabinet Office is called 府令."]),
    (4, "規則", None, None, "委員会等", 4, "national", True, False, "Rules of a commission or another body with its own authority.", ["人事院規則"], ["The word has several meanings: of courts, of commissions and of localities."]),
    (5, "条例", None, None, "地方議会", 5, "local", True, True, "An ordinance of a local assembly, valid in its area.", ["個人情報保護条例"], ["The national database has none of them.", "Localities differ in detail."]),
    (6, "告示", None, None, "各省庁", 6, "national", True, False, "A public notice that announces decisions and standards.", ["学習指導要領"], None),
    (7, "訓令", None, None, "上級機関", 99, "agency-internal", False, False, "An instruction from an agency to those below it.", ["文書管理規程"], None),
    (8, "通達", ["通知", "基本通達", "取扱通達"], None, "上級機関", 99, "agency-internal", False, False, "A circular on how agencies read and apply the law.", ["所得税基本通達"], ["Binds offices, not citizens."]),
    (9, "通知", None, None, "各省庁", 99, "agency-internal", False, False, "A notification of facts or views without binding force.", ["事務連絡"], None),
]


def law_types(spark: SparkSession) -> DataFrame:
    rows = [(*row[:-1], SOURCES[row[1]], row[-1]) for row in ROWS]
    return spark.createDataFrame(rows, SCHEMA)
