"""Entailment between statements by concepts, side, teeth and words; precision, recall and F1 of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import concepts as C
from ..functions import fixed_values as V
from ..functions import text as T
from .metrics import f1


def signed(df: DataFrame, text: str = "phrase") -> DataFrame:
    """df with sig: words, concepts (keys), pairs (key:polarity), side and teeth of each statement."""
    m = C.with_mentions(df, text)
    key = C.assertion_key(F.col("mentions"))
    none = F.array().cast("array<string>")
    pairs = F.coalesce(key["concepts"], none)
    sig = F.struct(
        T.content_tokens(F.col(text), V.STOPWORDS_ENTAILMENT).alias("words"), pairs.alias("pairs"),
        F.array_distinct(F.transform(pairs, lambda p: F.split_part(p, F.lit(":"), F.lit(1)))).alias("keys"),
        F.coalesce(key["side"], F.lit("unspecified")).alias("side"), F.coalesce(key["teeth"], F.array().cast("array<int>")).alias("teeth"),
    )
    return m.withColumn("sig", sig).drop("mentions")


def entailment(a: Column, b: Column) -> Column:
    """How far reference statement b supports candidate a, 0 to 1: a contrary polarity, side or tooth makes it 0."""
    shared = F.array_intersect(a["keys"], b["keys"])
    has = lambda s, k, p: F.array_contains(s["pairs"], F.concat(k, F.lit(f":{p}")))
    only = lambda s, k, p: F.size(F.filter(s["pairs"], lambda x: F.split_part(x, F.lit(":"), F.lit(1)) == k)) == F.when(has(s, k, p), 1).otherwise(-1)
    contrary = F.exists(shared, lambda k: (has(a, k, "present") & only(b, k, "absent")) | (has(a, k, "absent") & only(b, k, "present")))
    both = (F.size(a["keys"]) > 0) & (F.size(b["keys"]) > 0)
    concept = F.when(both, F.size(shared) / F.size(a["keys"])).when((F.size(a["keys"]) > 0) | (F.size(b["keys"]) > 0), 0.0).otherwise(0.5)
    wrong_side = (a["side"] != "unspecified") & (b["side"] != "unspecified") & (a["side"] != b["side"]) & ~((b["side"] == "bilateral") & a["side"].isin("left", "right"))
    common = F.arrays_overlap(a["teeth"], b["teeth"])
    wrong_teeth = (F.size(a["teeth"]) > 0) & (F.size(b["teeth"]) > 0) & ~common
    contained = F.coalesce(F.try_divide(F.size(F.array_intersect(a["words"], b["words"])), F.size(a["words"])), F.lit(0.0))
    score = F.least(F.lit(1.0), 0.55 * concept + 0.45 * contained + F.when(F.coalesce(common, F.lit(False)), 0.1).otherwise(0.0))
    return F.when((both & (F.size(shared) == 0)) | contrary | wrong_side | wrong_teeth, F.lit(0.0)).otherwise(score)


def entailed_pairs(candidates: DataFrame, evidence: DataFrame, threshold: float = V.ENTAILED_FROM, by: list[str] | None = None) -> DataFrame:
    """by, a, b: phrases of one group such that b supports a. Both sides: by, phrase, sig.

    Statements that share neither a word nor a tooth can't reach the threshold, so candidates meet evidence by an
    equi-join on those, never all by all; equal statements of a group are judged once."""
    if threshold <= 0.55:
        raise ValueError("below 0.55 a pair may pass without a common word")
    by = by or []
    tags = lambda s: F.explode(F.array_union(s["words"], F.transform(s["teeth"], lambda t: F.concat(F.lit("#"), t.cast("string")))))
    left = candidates.select(*by, F.col("phrase").alias("a"), F.col("sig").alias("sa")).dropDuplicates([*by, "a"])
    right = evidence.select(*by, F.col("phrase").alias("b"), F.col("sig").alias("sb")).dropDuplicates([*by, "b"])
    met = left.select(*by, "a", tags(F.col("sa")).alias("tag")).join(right.select(*by, "b", tags(F.col("sb")).alias("tag")), [*by, "tag"]).select(*by, "a", "b").distinct()
    return met.join(left, [*by, "a"]).join(right, [*by, "b"]).where(entailment(F.col("sa"), F.col("sb")) >= threshold).select(*by, "a", "b")


def supported(candidates: DataFrame, evidence: DataFrame, case: str = "case_id", threshold: float = V.ENTAILED_FROM) -> DataFrame:
    """candidates: case, phrase, sig; evidence the same. Adds entailed: whether any statement of the case supports it."""
    good = entailed_pairs(candidates, evidence, threshold, [case]).select(case, F.col("a").alias("phrase")).distinct().withColumn("entailed", F.lit(True))
    return candidates.join(good, [case, "phrase"], "left").fillna(False, ["entailed"])


def report_statements(reports: DataFrame, text: str, case: str = "case_id") -> DataFrame:
    """case, position, phrase, sig of a report's verifiable statements."""
    found = reports.select(case, F.posexplode(T.phrases(F.col(text))).alias("position", "phrase")).where(T.is_verifiable(F.col("phrase")))
    return signed(found)


def clinical_scores(pairs: DataFrame, threshold: float = V.ENTAILED_FROM) -> DataFrame:
    """Per case precision (statements of the prediction that the reference supports), recall (the reverse), F1, counts."""
    # both sides' statements are parsed in one go
    sides = pairs.select("case_id", F.explode(F.array(F.struct(F.lit("p").alias("side"), F.col("prediction").alias("text")), F.struct(F.lit("r").alias("side"), F.col("reference").alias("text")))).alias("s")).select("case_id", "s.*")
    found = sides.select("case_id", "side", F.posexplode(T.phrases(F.col("text"))).alias("position", "phrase")).where(T.is_verifiable(F.col("phrase")))
    # all that a case needs is brought together once, and both directions are judged within its row
    of = lambda x: F.collect_list(F.when(F.col("side") == x, F.col("sig")))
    told = signed(found).select("case_id", "side", "sig").groupBy("case_id").agg(of("p").alias("p"), of("r").alias("r"))
    backed = lambda x, y: F.size(F.filter(x, lambda a: F.exists(y, lambda b: entailment(a, b) >= threshold)))
    counts = told.select("case_id", *[c.cast("long").alias(n) for x, y, name in (("p", "r", "candidate"), ("r", "p", "reference")) for c, n in ((F.size(x), f"{name}_count"), (backed(x, y), f"entailed_{name}_count"))])
    both = pairs.select("case_id").join(counts, "case_id", "left").fillna(0)
    share = lambda n: F.coalesce(F.try_divide(F.col(f"entailed_{n}_count"), F.col(f"{n}_count")), F.lit(0.0))
    out = both.withColumn("logical_precision", share("candidate")).withColumn("logical_recall", share("reference"))
    return out.withColumn("logical_f1", f1(F.col("logical_precision"), F.col("logical_recall")))


def clinical_aggregate(cases: DataFrame) -> DataFrame:
    """F1 of mean precision and mean recall, not the mean of the cases' F1."""
    means = cases.groupBy().agg(F.avg("logical_precision").alias("logical_precision"), F.avg("logical_recall").alias("logical_recall"), F.count("*").alias("num_samples"))
    return means.withColumn("logical_f1", f1(F.col("logical_precision"), F.col("logical_recall")))
