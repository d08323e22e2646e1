"""Statements on findings for the rows of `documents`, whose own prose names none: templates chosen and filled by doc_id, alike
in Spark and in SQL. A case is a document, with PER_CASE statements; its report is their paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .statement_sql import listed

PER_CASE = 5
#: {t}: a tooth, {m}: millimetres, {s}: a side.
TEMPLATES = [
    "The {s} maxillary sinus shows mucosal thickening of 1.{m} cm.",
    "No periapical lesion is seen at tooth {t}.",
    "Absence from the arch of teeth {t}, 36 and 37.",
    "Left and right mandibular canals are regular, with a predominantly lingual course.",
    "Impacted tooth {t} in contact with the mandibular canal.",
    "The maxilla is partially included in the scan and is not assessable.",
    "Composite fillings on teeth {t} and 46.",
    "Complete edentulism of the mandible.",
    "Possible cyst measuring {m},5 mm near element {t}.",
    "The condyles are not included in the acquired volume.",
    "No significant abnormality.",
    "Tooth {t} has an endodontic treatment.",
    "Canal course is predominantly buccal.",
    "A periapical lesion is visible at tooth {t}.",
    "Impacted tooth {t} in contact with the mandibular canal, suspected cyst of {m} mm.",
    "The {s} maxillary sinus is clear.",
    "Root fracture of tooth {t} is suspected.",
    "Bone loss of {m} mm around tooth {t}.",
    "No impacted teeth.",
    "An implant replaces tooth {t}.",
]


def _text(doc: Column, k: Column) -> Column:
    pick = (doc * 7 + k * 3 + F.floor(doc / 11)) % len(TEMPLATES)
    text = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (pick + 1).cast("int"))
    tooth = (doc + k) % 4 * 10 + 11 + (F.floor(doc / 4) + k * 3) % 8
    for name, value in (("{t}", tooth.cast("int").cast("string")), ("{m}", (2 + (doc + k) % 7).cast("string")), ("{s}", F.when((doc + k) % 2 == 0, "left").otherwise("right"))):
        text = F.replace(text, F.lit(name), value)
    return text


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, case_id, k, text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("case_id"), F.explode(F.sequence(F.lit(0), F.lit(PER_CASE - 1))).alias("k"))
    return docs.select((F.col("case_id") * PER_CASE + F.col("k")).alias("id"), "case_id", "k", _text(F.col("case_id"), F.col("k")).alias("text"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, report."""
    told = statements(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("s"))
    return told.select("case_id", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("report"))


def bank(spark: SparkSession, sf_dir: str, most: int = 30) -> DataFrame:
    """The statements that most cases have: proto, text, support, position."""
    from pyspark.sql import Window as W

    counts = statements(spark, sf_dir).groupBy("text").agg(F.count_distinct("case_id").alias("support"))
    top = counts.orderBy(F.desc("support"), "text").limit(most)
    placed = top.withColumn("proto", (F.row_number().over(W.orderBy(F.desc("support"), "text")) - 1).cast("int"))
    return placed.select("proto", "text", "support", F.col("proto").alias("position"))


def probabilities(spark: SparkSession, sf_dir: str, most: int = 30) -> DataFrame:
    """case_id, proto, p: a probability of each statement in each case, by arithmetic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("case_id"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("proto"))
    return docs.withColumn("p", ((F.col("case_id") * 37 + F.col("proto") * 101) % 97 / 97.0).cast("float"))


#: CTEs bank (proto, text) and pr (case_id, proto, p), after st.
SQL_BANK = """bank AS MATERIALIZED (SELECT row_number() OVER (ORDER BY support DESC, text) - 1 AS proto, text FROM (SELECT text, count(DISTINCT case_id) AS support FROM told GROUP BY text) ORDER BY proto LIMIT 30),
 pr AS (SELECT doc_id AS case_id, proto, ((doc_id * 37 + proto * 101) % 97 / 97.0::DOUBLE)::FLOAT AS p FROM documents, range(30) r(proto))"""
_PLACE = f"CAST((doc_id * 7 + k * 3 + doc_id // 11) % {len(TEMPLATES)} AS INTEGER) + 1"
_TOOTH = "CAST((doc_id + k) % 4 * 10 + 11 + (doc_id // 4 + k * 3) % 8 AS VARCHAR)"
#: CTE st (id, case_id, k, text).
SQL = f"""st AS MATERIALIZED (SELECT doc_id * {PER_CASE} + k AS id, doc_id AS case_id, k,
  replace(replace(replace(({listed(TEMPLATES)})[{_PLACE}], '{{t}}', {_TOOTH}), '{{m}}', CAST(2 + (doc_id + k) % 7 AS VARCHAR)), '{{s}}', CASE WHEN (doc_id + k) % 2 = 0 THEN 'left' ELSE 'right' END) AS text
  FROM documents, range({PER_CASE}) r(k))"""
