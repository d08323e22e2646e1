"""Scores of predictions against references: corpus BLEU, METEOR by alignment, legacy forms, term F1, roll-ups.

pairs: case_id, prediction, reference. A case is one row, and is counted within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import fixed_values as V
from ..functions import text as T

EPSILON = 0.1
ORDERS = (1, 2, 3, 4)
def tokenized(pairs: DataFrame) -> DataFrame:
    """pairs with token arrays p (prediction) and r (reference)."""
    return pairs.withColumn("p", T.tokens(F.col("prediction"))).withColumn("r", T.tokens(F.col("reference")))


def _common(p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that both sides have, and how often both have them."""
    (a, n), (b, m) = (np.unique(x, return_counts=True) for x in (p, r))
    keys, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return keys, np.minimum(n[i], m[j])


def _nth(keys: np.ndarray) -> np.ndarray:
    """For each key how many equal ones stand before it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
    return out


def _row_counts(p: list[np.ndarray], r: list[np.ndarray]) -> dict[str, np.ndarray]:
    """p, r: (tokens, bounds of each row) of both sides. The counts of `pair_counts`."""
    (pt, pb), (rt, rb) = p, r
    rows = len(pb) - 1
    owner = [np.repeat(np.arange(rows), np.diff(b)) for b in (pb, rb)]
    tokens = np.unique(np.concatenate([pt, rt]), return_inverse=True)[1]
    sides = [tokens[: len(pt)], tokens[len(pt) :]]
    base = int(tokens.max(initial=0)) + 1
    out = {"np": np.diff(pb), "nr": np.diff(rb)}
    grams = sides
    for n in ORDERS:
        if n > 1:  # the n-gram that begins at a place, from the shorter one and the next token, numbered anew
            longer = [g[:-1] * base + t[n - 1 :] for g, t in zip(grams, sides, strict=True)]
            codes = np.unique(np.concatenate(longer), return_inverse=True)[1]
            grams = [codes[: len(longer[0])], codes[len(longer[0]) :]]
        inside = [o[: max(0, len(o) - n + 1)] == o[n - 1 :] for o in owner]
        held = [o[: len(i)][i] for o, i in zip(owner, inside, strict=True)]
        span = int(max(g.max(initial=0) for g in grams)) + 1
        keys, both = _common(*(h * span + g[i] for h, g, i in zip(held, grams, inside, strict=True)))
        out[f"m{n}"] = np.bincount(keys // span, both, rows).astype(np.int64)
        out[f"t{n}"] = np.bincount(held[0], minlength=rows)
    # METEOR: the k-th occurrence of a token meets the k-th of the other side
    places = [o * base + t for o, t in zip(owner, sides, strict=True)]
    nth = [_nth(x) for x in places]
    most = max(n.max(initial=0) for n in nth) + 1
    _, pi, ri = np.intersect1d(*(x * most + n for x, n in zip(places, nth, strict=True)), assume_unique=True, return_indices=True)
    order = np.argsort(pi)
    case, at = owner[0][pi[order]], ri[order]
    new = np.ones(len(at), bool)
    new[1:] = (case[1:] != case[:-1]) | (at[1:] != at[:-1] + 1)
    return out | {"matches": np.bincount(case, minlength=rows), "chunks": np.bincount(case, new, rows).astype(np.int64)}


COUNTS = ["np", "nr", *[f"{x}{n}" for n in ORDERS for x in "mt"], "matches", "chunks"]
#: Tokens (one case's at least) that are counted in one go.
SLICE_TOKENS = 1 << 16


def pair_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, np and nr (tokens of prediction and reference), for n of 1 to 4 m<n> (common n-grams, each as often as both have
    it) and t<n> (n-grams of the prediction), matches and chunks of METEOR's alignment.

    All that a case needs is in its row, so rows are counted where they lie, and nothing is shuffled."""
    hashed = lambda c: F.transform(T.tokens(F.col(c)), lambda t: F.xxhash64(t))
    rows = pairs.select(*keys, hashed("prediction").alias("_p"), hashed("reference").alias("_r"))
    schema = StructType([*(rows.schema[k] for k in keys), *(StructField(c, LongType()) for c in COUNTS)])

    def side(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.asarray(column.offsets)
        return np.asarray(column.flatten()), bounds - bounds[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, a = np.cumsum(sum(np.diff(side(batch.column(c))[1]) for c in ("_p", "_r"))), 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_TOKENS, "right")))
                part = batch.slice(a, b - a)
                found = _row_counts(side(part.column("_p")), side(part.column("_r")))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=[*keys, *COUNTS])
                a = b

    return rows.mapInArrow(run, schema)


def bleu_from_sums(num: list[Column], den: list[Column], ref_len: Column, hyp_len: Column) -> Column:
    """BLEU-4 of summed counts: an order without a match counts EPSILON; 0 where no single token matches."""
    logs = [F.log(F.when(a == 0, F.lit(EPSILON) / b).otherwise(a / b)) for a, b in zip(num, den, strict=True)]
    brevity = F.when(hyp_len > ref_len, F.lit(1.0)).when(hyp_len == 0, F.lit(0.0)).otherwise(F.exp(1.0 - ref_len / hyp_len))
    return F.when(num[0] == 0, F.lit(0.0)).otherwise(brevity * F.exp(sum(logs) / float(len(num))))


def _bleu_columns() -> list[Column]:
    """Of a group of `pair_counts`: n1..n4, d1..d4, hyp_len, ref_len, cases. A case too short for an order adds 1 to its
    denominator."""
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return [*(zero(f"m{n}", f"n{n}") for n in ORDERS), *(zero(F.greatest(F.lit(1), F.col("np") - (n - 1)), f"d{n}") for n in ORDERS), zero("np", "hyp_len"), zero("nr", "ref_len"), F.count("*").alias("cases")]


def _bleu() -> Column:
    score = bleu_from_sums([F.col(f"n{n}") for n in ORDERS], [F.col(f"d{n}") for n in ORDERS], F.col("ref_len"), F.col("hyp_len"))
    return F.when(F.col("cases") == 0, F.lit(0.0)).otherwise(score)


def corpus_bleu(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """BLEU-4 of the whole corpus, or of each group: counts are summed over the cases before they are divided."""
    parts = pair_counts(pairs, by or []).groupBy(*(by or [])).agg(*_bleu_columns())
    return parts.select(*(by or []), "cases", F.col("hyp_len").alias("prediction_tokens"), F.col("ref_len").alias("reference_tokens"), _bleu().alias("bleu_4"))


def legacy_bleu(pairs: DataFrame) -> DataFrame:
    """BLEU-4 with one added to every numerator and denominator; denominators take no least of 1 a case."""
    sums = pair_counts(pairs, []).groupBy().agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS], F.count("*").alias("cases"))
    logs = sum(F.log((F.col(f"m{n}") + 1) / (F.col(f"t{n}") + 1)) for n in ORDERS)
    brevity = F.when(F.col("np") > F.col("nr"), 1.0).otherwise(F.exp(1.0 - F.col("nr") / F.col("np")))
    return sums.select("cases", F.when(F.col("np") == 0, 0.0).otherwise(brevity * F.exp(logs / 4)).alias("bleu_4_proxy"))


def alignment(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Matched token places (keys, pi, ri): the k-th occurrence of a token meets the k-th of the other side.

    That is what a greedy walk finds that takes the first unused equal token, and it needs no walk."""
    side = lambda name, s: tokens.select(*keys, F.posexplode(name).alias("pos", "token")).withColumn("side", F.lit(s))
    placed = side("p", 1).union(side("r", 0)).repartition(*keys)
    nth = placed.withColumn("k", F.row_number().over(W.partitionBy(*keys, "side", "token").orderBy("pos")))
    met = nth.groupBy(*keys, "token", "k").agg(F.max(F.when(F.col("side") == 1, F.col("pos"))).alias("pi"), F.max(F.when(F.col("side") == 0, F.col("pos"))).alias("ri"))
    return met.where("pi is not null and ri is not null").select(*keys, "pi", "ri")


def _meteor() -> Column:
    """Of a row of `pair_counts`: F * (1 - penalty), F weighing recall nine to one, penalty 0.5 (chunks/matches)^3. Both sides
    empty score 1, one empty or nothing in common 0."""
    precision, recall = F.col("matches") / F.col("np"), F.col("matches") / F.col("nr")
    mean = 10 * precision * recall / (recall + 9 * precision)
    value = mean * (1 - 0.5 * F.pow(F.col("chunks") / F.col("matches"), 3))
    return F.when((F.col("np") == 0) & (F.col("nr") == 0), 1.0).when(F.col("matches") == 0, 0.0).otherwise(value)


def meteor(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per case: np, nr, matches, chunks, meteor."""
    keys = keys or ["case_id"]
    return pair_counts(pairs, keys).select(*keys, "np", "nr", "matches", "chunks", _meteor().alias("meteor"))


def caption_scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """BLEU-4, mean METEOR and their mean, for the corpus or each group; cases are counted once for both."""
    by = by or []
    sums = pair_counts(pairs, by).withColumn("meteor", _meteor()).groupBy(*by).agg(*_bleu_columns(), F.avg("meteor").alias("meteor"))
    both = sums.select(*by, "cases", _bleu().alias("bleu_4"), "meteor")
    return both.select(*by, "cases", "bleu_4", "meteor", ((F.col("bleu_4") + F.col("meteor")) / 2).alias("captioning"))


def across_groups(scores: DataFrame, how: str = "mean") -> DataFrame:
    """Of the groups' scores their plain mean, or the worst of each metric."""
    fold = F.avg if how == "mean" else F.min
    return scores.groupBy().agg(F.count("*").alias("groups"), fold("bleu_4").alias("bleu_4"), fold("meteor").alias("meteor"))


def term_f1(pairs: DataFrame) -> DataFrame:
    """Per case the F1 of which of seven terms each side names; both none 1, one none 0."""
    named = lambda c: F.array_compact(F.array(*[F.when(F.col(c).rlike(f"(?iU){p}"), F.lit(k)) for k, p in V.LEGACY_TERMS.items()]))
    both = pairs.withColumn("a", named("prediction")).withColumn("b", named("reference")).withColumn("c", F.size(F.array_intersect("a", "b")))
    return both.select("case_id", F.coalesce(F.try_divide(2.0 * F.col("c"), F.size("a") + F.size("b")), F.lit(1.0)).alias("term_f1"))


def legacy_scores(pairs: DataFrame) -> DataFrame:
    """The legacy roll-up: bleu_4_proxy, meteor_lite, clinical_term_f1_proxy, num_cases."""
    m = meteor(pairs).groupBy().agg(F.avg("meteor").alias("meteor_lite"))
    t = term_f1(pairs).groupBy().agg(F.avg("term_f1").alias("clinical_term_f1_proxy"))
    return legacy_bleu(pairs).join(m).join(t).select("bleu_4_proxy", "meteor_lite", "clinical_term_f1_proxy", F.col("cases").alias("num_cases"))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * p * r, p + r), F.lit(0.0))


def first_reference(references: Column) -> Column:
    """Of several reference reports the one that captions are scored against."""
    return F.get(references, 0)


def joined_references(references: Column) -> Column:
    """Of several reference reports the text that clinical statements are looked for in."""
    return F.array_join(references, " ")


def challenge_scores(predictions: DataFrame, references: DataFrame, by: list[str] | None = None) -> DataFrame:
    """predictions: case_id, prediction and by; references: case_id, references (one report or more). Final score with its
    parts, for all cases or each group: captions against the first reference, statements against all of them joined.

    Cases that only one side has are left out; raises if there is none on both."""
    from . import entail

    by = by or []
    both = predictions.select(*by, "case_id", "prediction").join(references.select("case_id", "references"), "case_id")
    if both.isEmpty():
        raise ValueError("no case has a prediction and references")
    captions = caption_scores(both.withColumn("reference", first_reference(F.col("references"))), by)
    # a case may have a prediction in several groups
    named = both.withColumn("reference", joined_references(F.col("references"))).withColumn("pair", F.struct(*by, "case_id"))
    clinical = entail.clinical_scores(named.select(F.col("pair").alias("case_id"), "prediction", "reference")).select(*[F.col(f"case_id.{b}").alias(b) for b in by], "logical_precision", "logical_recall")
    means = clinical.groupBy(*by).agg(F.avg("logical_precision").alias("logical_precision"), F.avg("logical_recall").alias("logical_recall"))
    scored = (captions.join(means, by) if by else captions.crossJoin(means)).withColumn("clinical", f1(F.col("logical_precision"), F.col("logical_recall")))
    return scored.withColumn("final", final_score(F.col("clinical"), F.col("bleu_4"), F.col("meteor")))


def final_score(clinical: Column, bleu: Column, meteor_: Column, clinical_weight: float = 0.8, captioning_weight: float = 0.2) -> Column:
    return clinical_weight * clinical + captioning_weight * (bleu + meteor_) / 2
