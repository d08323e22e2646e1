"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each document of a source stands in a shuffled line; its virtual finish time is the source's running sum of tokens
divided by the source's target. All documents, sorted by finish time and cut at the total budget, are the mix.

Running sums are never taken over a whole source or the whole table in one task: rows are first summed by small ranges
of the sort key, the short table of range sums is accumulated, and rows are ordered only within their range. Until virtual
time 1 a source's finish times are spread evenly by the shuffle, so ranges of it are narrow whatever the sources' sizes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import materialize

#: Rows that a range of a running sum holds on average.
RANGE_ROWS = 4096
#: A source is repeated so many times at most.
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Runs of anything but the ASCII white space characters; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """sizes: one row a source (source, source_size). Adds weight and target: shares of the sum of all sizes by weight,
    none above most_epochs times its own size, the excess dealt again by weight.

    The water level: with sources sorted by cap/weight, the first k are at their caps and the others get what is left
    by weight; k is the smallest for which none of the others passes its cap. A running sum over one row a source.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    caps = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * float(most_epochs))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    whole = W.partitionBy()
    filled = (
        caps.withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("below_cap", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("from_weight", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("water", (F.sum("source_size").over(whole) - F.col("below_cap")) / F.col("from_weight"))
    )
    # from the first source on whose level is above the water, all get water * weight
    # (the first of those of one level, in the order of the sums)
    lowest = F.min(F.when(F.col("level") >= F.col("water"), F.struct("level", F.col("source").isNull().alias("none"), "source", "water"))).over(whole)
    settled = filled.withColumn("lowest", lowest)
    target = F.when(F.col("lowest").isNull() | (F.col("level") < F.col("lowest.level")), F.col("cap")).otherwise(F.col("lowest.water") * F.col("weight"))
    return settled.select("source", "source_size", "weight", F.least(target, F.col("cap")).alias("target"))


def fair_queue(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text", most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The queue in its global order, cut at the total budget: a row for each document and epoch, range-sorted by virtual
    finish time, those that finish after virtual time 1 or have no words last and in no order.

    Columns: doc_id, source, size, source_size, weight, target, place (running sum of sizes within the source: with the
    source it names the row), epoch, finish, part. part is what the mix takes of the row: the queue is served in order of
    finish until the running sum of words reaches the budget, the sum of all targets; what comes later has part 0. A
    document that its source is sending when its target is reached stands in the queue in two rows, so that the part
    up to the target finishes at virtual time 1 and the rest after it.

    Sizes count words. Null sources form a source of their own that comes last, null texts have size 0 and are never
    taken, null or repeated keys are rows like any other, an empty table gives no rows, further columns are not read.
    The shuffle is a hash of key and seed, so reruns agree.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    rows = materialize(rows.withColumn("turn", F.xxhash64(F.lit(seed), "doc_id")), "mix_sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    spans = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / RANGE_ROWS)).cast("long")
    goal = targets(per_source, weights, most_epochs).join(per_source.select(F.col("source").alias("s"), spans.alias("spans")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = materialize(goal, "mix_targets").withColumnRenamed("source", "s")
    # running sums within each source, by equal ranges of the hash: of the hash's upper 32 bits, from 0
    high = F.shiftright("turn", 32) + F.lit(1 << 31)
    lined = rows.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("span", F.floor(high * F.col("spans") / F.lit(1 << 32)).cast("long"))
    span_sums = lined.groupBy("source", "span").agg(F.sum("size").alias("n"))
    ahead = span_sums.select(F.col("source").alias("s"), F.col("span").alias("p"), (F.sum("n").over(W.partitionBy("source").orderBy("span")) - F.col("n")).alias("ahead"))
    in_span = W.partitionBy("source", "span").orderBy("turn", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    lined = lined.withColumn("own", F.sum("size").over(in_span)).withColumn("nth", F.row_number().over(in_span))
    lined = lined.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("p")))
    # an epoch beyond the first is queued only if the budget can reach it
    reach = F.coalesce(F.ceil(F.try_divide("target", "source_size")).cast("int"), F.lit(1)) - 1
    queued = lined.select("doc_id", "source", "size", "source_size", "weight", "target", "span", "nth", (F.col("ahead") + F.col("own")).alias("place"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(most_epochs - 1), reach)))).alias("epoch"))
    # whole words of the target; the document that passes it stands in two rows
    done, due = F.col("place") + F.col("epoch") * F.col("source_size"), F.floor(F.col("target") + 1e-6)
    before = done - F.col("size")
    row = lambda size, finish: F.struct(size.cast("long").alias("words"), finish.cast("double").alias("finish"))
    after = F.greatest(F.try_divide(done, "target"), F.lit(1.0 + 1e-12))
    passing = F.array(row(due - before, F.lit(1.0)), row(done - due, after))
    once = F.array(row(F.col("size"), F.when(done <= due, F.least(F.try_divide(done, "target"), F.lit(1.0))).otherwise(after)))
    sent = queued.select("*", F.explode(F.when((before < due) & (due < done), passing).otherwise(once)).alias("sent")).select(*queued.columns, "sent.*")
    sent = sent.withColumn("finish", F.coalesce("finish", F.lit(float(most_epochs + 1))))
    sent = materialize(sent, "mix_queue")
    # sources meet their targets at virtual time 1, so the words until then are the budget at least: what finishes later is
    # past the cut, needs no place in the order and, of a large source, may be most of its rows; so are rows without words
    late, sent = sent.where("finish > 1 or words = 0"), sent.where("finish <= 1 and words > 0")
    # running sum in order of finish, by narrow ranges of it, summed in two steps, so no task sees more than a short list
    ranges = max(1, -(-sent.count() // RANGE_ROWS))
    sent = sent.withColumn("range", F.floor(F.col("finish") * ranges).cast("long"))
    sums = sent.groupBy("range").agg(F.sum("words").alias("n")).withColumn("group", F.floor(F.col("range") / RANGE_ROWS).cast("long"))
    groups = sums.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.select(F.col("group").alias("g"), (F.sum("n").over(W.orderBy("group")) - F.col("n")).alias("base"))
    inside = F.sum("n").over(W.partitionBy("group").orderBy("range")) - F.col("n")
    ahead = sums.withColumn("inside", inside).join(groups, F.col("group") == F.col("g")).select(F.col("range").alias("r"), (F.col("inside") + F.col("base")).alias("ahead"))
    budget = goal.agg(F.coalesce(F.sum(F.floor(F.col("target") + 1e-6)), F.lit(0)).cast("long").alias("budget"))
    in_range = W.partitionBy("range").orderBy("finish", F.col("source").isNull(), "source", "epoch", "place", "nth").rowsBetween(W.unboundedPreceding, 0)
    queue = sent.repartitionByRange("range").withColumn("upto", F.sum("words").over(in_range)).join(ahead, F.col("range") == F.col("r")).crossJoin(budget)
    left = F.col("budget") - (F.col("ahead") + F.col("upto") - F.col("words"))
    queue = queue.withColumn("part", F.greatest(F.lit(0), F.least(F.col("words"), left)).cast("long")).drop("words", "range", "r", "upto", "ahead", "budget")
    return queue.unionByName(late.withColumn("part", F.lit(0).cast("long")).drop("words"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document, from the queue: doc_id, source, size, source_size, weight, target, taken (its parts, repeats counted)."""
    served = fair_queue(docs, **options)
    row = ["doc_id", "source", "size", "source_size", "weight", "target", "span", "nth"]
    return served.groupBy(*row).agg(F.sum("part").alias("taken")).drop("span", "nth")


def mixed(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", chars: str | None = "n_chars", **options) -> DataFrame:
    """docs, all columns, as the mix has them: a row for each time that a document is taken, the one that the cut runs
    through with its first words only (and chars, its length, set anew). Documents that are not taken are left out, null
    and wordless texts among them; null sources, null and repeated keys are as in `fair_queue`; an empty table stays empty;
    further columns of any name go along."""
    tag = uuid.uuid4().hex
    served = fair_queue(docs, key=key, source=source, text=text, **options).where("part > 0")
    served = materialize(served.select("doc_id", "source", "size", "place", "epoch", "part"), "mix_served")
    rows = docs.withColumn(f"words_{tag}", word_count(F.col(text)))
    # rows alike in key, source and size are told apart by number; only then are they numbered
    alike = ["doc_id", "source", "size", "epoch"]
    numbered = not served.groupBy(*alike).agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    if numbered:
        served = served.withColumn("nth", F.row_number().over(W.partitionBy(*alike).orderBy("place")))
        rows = rows.withColumn(f"n_{tag}", F.row_number().over(W.partitionBy(key, source, f"words_{tag}").orderBy(text)))
    served = served.select(*[F.col(c).alias(f"{c}_{tag}") for c in served.columns])
    same = F.col(key).cast("long").eqNullSafe(F.col(f"doc_id_{tag}")) & F.col(source).cast("string").eqNullSafe(F.col(f"source_{tag}")) & (F.col(f"words_{tag}") == F.col(f"size_{tag}"))
    taken = rows.join(served, same & (F.col(f"n_{tag}") == F.col(f"nth_{tag}")) if numbered else same)
    # cut after each word, each piece with the white space before it
    pieces = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first_words = F.array_join(F.slice(pieces, F.lit(1), F.col(f"part_{tag}").cast("int")), "")
    cut = F.col(f"part_{tag}") < F.col(f"size_{tag}")
    out = taken.withColumn(text, F.when(cut, first_words).otherwise(F.col(text)))
    if chars and chars in docs.columns:
        out = out.withColumn(chars, F.when(cut, F.length(text)).otherwise(F.col(chars)).cast(docs.schema[chars].dataType))
    return out.select(*docs.columns)
