"""Concept mentions in phrases: which catalogue concepts a phrase states, with polarity, side, teeth and measurements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import materialize
from . import fixed_values as V


@dataclass(frozen=True)
class Concept:
    key: str
    section: str
    #: t: has teeth, l: has a side, m: has measurements, a: states an absence.
    flags: str
    patterns: tuple[str, ...]


def _searched(c: V.Concept) -> Concept:
    """The concept with its patterns, those of coverage made from the anatomy."""
    flags = "".join(f for f, has in (("t", c.tooth_specific), ("l", c.lateralized), ("m", c.measurable), ("a", c.denotes_absence)) if has)
    covered = () if c.covers is None else (
        rf"\b(?:{c.covers})\b[^.]{{0,70}}?\b(?:{V.COVERAGE_VERB})\b",
        rf"\b(?:{V.COVERAGE_VERB})\b[^.]{{0,40}}?\b(?:{V.COVERAGE_SCOPE})\b[^.]{{0,40}}?\b(?:{c.covers})\b",
    )
    return Concept(c.key, c.section, flags, (*c.patterns, *covered))


CONCEPTS = [_searched(c) for c in V.CATALOGUE]
_I = "(?iU)"


def teeth(text: Column) -> Column:
    """Tooth numbers in two-digit notation: those named as teeth, or else any that stand alone; sorted, distinct."""
    named = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"(?U){V.TOOTH_NUMBER}"), F.lit(1)), lambda s: F.regexp_extract_all(s, F.lit(r"(?U)\d{2}"), F.lit(0))))
    bare = F.regexp_extract_all(text, F.lit(f"(?U){V.BARE_TOOTH}"), F.lit(1))
    numbers = F.transform(F.when(F.size(named) > 0, named).otherwise(bare), lambda s: s.cast("int"))
    good = F.filter(numbers, lambda n: n.cast("string").rlike("^([1-4][1-8]|[5-8][1-5])$"))
    return F.array_sort(F.array_distinct(good))


def measurements(text: Column) -> Column:
    """Lengths in millimetres, in the order of the text."""
    pattern = F.lit(_I + V.MEASUREMENT)
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("amount"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("unit"))
    value = lambda p: F.replace(p["amount"], F.lit(","), F.lit(".")).cast("double")
    return F.transform(pairs, lambda p: F.when(F.lower(p["unit"]).rlike("^c"), value(p) * 10.0).otherwise(value(p)))


def laterality(text: Column) -> Column:
    left, right = text.rlike(_I + V.LEFT), text.rlike(_I + V.RIGHT)
    return F.when(text.rlike(_I + V.BILATERAL) | (left & right), F.lit("bilateral")).when(left, F.lit("left")).when(right, F.lit("right")).otherwise(F.lit("unspecified"))


def _span(text: Column, concept: Concept) -> Column:
    """(end, start) from 0 of the earliest-ending first match over the concept's patterns; null without one."""
    found = []
    for p in concept.patterns:
        at = F.regexp_instr(text, F.lit(_I + p))
        found.append(F.when(at > 0, F.struct((at - 1 + F.length(F.regexp_substr(text, F.lit(_I + p)))).alias("end"), (at - 1).alias("start"))))
    return F.array_min(F.array_compact(F.array(*found)))


MENTION = "struct<concept:string,polarity:string,laterality:string,teeth:array<int>,measurements:array<double>>"


def mentions(text: Column, concepts: list[Concept] = CONCEPTS) -> Column:
    """Array of mentions in catalogue order. A negation cue counts against a concept if it begins before the concept is
    stated in full (before it begins, for concepts that mean absence), and only the first cue can matter."""
    cue = F.regexp_instr(text, F.lit(_I + V.NEGATION)) - 1
    unsure, side, numbers, sizes = text.rlike(_I + V.UNCERTAINTY), laterality(text), teeth(text), measurements(text)
    # the matches are one array beside the catalogue's, so that each pattern stands in the plan once
    spans = F.array(*[_span(text, c) for c in concepts])
    known = F.array(*[F.struct(F.lit(c.key).alias("key"), F.lit(c.flags).alias("flags")) for c in concepts])

    def mention(span: Column, c: Column) -> Column:
        has = lambda flag: F.contains(c["flags"], F.lit(flag))
        boundary = F.when(has("a"), span["start"]).otherwise(span["end"])
        polarity = F.when((span["cue"] >= 0) & (span["cue"] < boundary), F.lit("absent")).when(span["unsure"], F.lit("uncertain")).otherwise(F.lit("present"))
        return F.struct(
            c["key"].alias("concept"), polarity.alias("polarity"),
            F.when(has("l"), span["side"]).otherwise(F.lit("unspecified")).alias("laterality"),
            F.when(has("t"), span["numbers"]).otherwise(F.array().cast("array<int>")).alias("teeth"),
            F.when(has("m"), span["sizes"]).otherwise(F.array().cast("array<double>")).alias("measurements"),
        )

    context = F.struct(cue.alias("cue"), unsure.alias("unsure"), side.alias("side"), numbers.alias("numbers"), sizes.alias("sizes"))
    hit = F.filter(F.zip_with(spans, known, lambda s, c: F.struct(s.alias("s"), c.alias("c"))), lambda p: p["s"].isNotNull())
    # what the whole text says is put beside each match once
    return F.flatten(F.transform(F.array(context), lambda x: F.transform(hit, lambda p: mention(F.struct(p["s"]["start"].alias("start"), p["s"]["end"].alias("end"), x["cue"].alias("cue"), x["unsure"].alias("unsure"), x["side"].alias("side"), x["numbers"].alias("numbers"), x["sizes"].alias("sizes")), p["c"]))))


def with_mentions(df: DataFrame, text: str = "text", to: str = "mentions") -> DataFrame:
    """df with the mentions of each text. Distinct texts are parsed once and joined back, as statements repeat a lot.

    They are dealt to as many tasks as a shuffle has, however short they are, since parsing is what costs. What is parsed is
    written: a reader's filters would have it parsed again, and its size tells Spark whether it may go to all."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = df.select(F.col(text).alias("_t")).distinct().repartition(tasks, "_t")
    parsed = materialize(some.select("_t", mentions(F.col("_t")).alias(to)), "mentions")
    return df.join(parsed, F.col(text).eqNullSafe(F.col("_t")), "left").drop("_t")


def section(text: Column, concepts: list[Concept] = CONCEPTS) -> Column:
    """Section of the first concept of the catalogue that the text matches, else other."""
    cases = [F.when(F.greatest(*hits) if len(hits := [text.rlike(_I + p) for p in c.patterns]) > 1 else hits[0], F.lit(c.section)) for c in concepts]
    return F.coalesce(*cases, F.lit("other"))


def section_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in V.SECTIONS]), name) - 1


def assertion_key(found: Column) -> Column:
    """What a statement asserts, fit for grouping: sorted concepts with polarity, side, sorted teeth; null if nothing."""
    pairs = F.array_sort(F.array_distinct(F.transform(found, lambda m: F.concat_ws(":", m["concept"], m["polarity"]))))
    sides = F.filter(F.transform(found, lambda m: m["laterality"]), lambda s: s != "unspecified")
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda m: m["teeth"]))))
    key = F.struct(pairs.alias("concepts"), F.when(F.size(sides) > 0, F.element_at(sides, 1)).otherwise(F.lit("unspecified")).alias("side"), numbers.alias("teeth"))
    return F.when(F.size(found) > 0, key)


def profile(mentioned: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows (key, concept, polarity): the strongest polarity of each concept, present over uncertain over absent."""
    m = mentioned.select(key, F.explode("mentions").alias("m"))
    strength = F.when(F.col("m.polarity") == "present", 3).when(F.col("m.polarity") == "uncertain", 2).otherwise(1)
    return m.groupBy(key, F.col("m.concept").alias("concept")).agg(F.max_by("m.polarity", strength).alias("polarity"))


def profile_changes(before: DataFrame, after: DataFrame, key: str = "case_id") -> DataFrame:
    """Per key the concepts that after adds, drops, or states with another polarity; each list sorted."""
    a, b = before.withColumnRenamed("polarity", "was"), after.withColumnRenamed("polarity", "is")
    both = a.join(b, [key, "concept"], "full_outer")
    pick = lambda when: F.sort_array(F.collect_list(F.when(when, F.col("concept"))))
    return both.groupBy(key).agg(pick(F.col("was").isNull()).alias("added"), pick(F.col("is").isNull()).alias("dropped"), pick(F.col("was") != F.col("is")).alias("flipped"))
