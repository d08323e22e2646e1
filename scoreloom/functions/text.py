"""Text functions on columns: normal form, sentences, phrases, canonical keys, tokens, n-grams. All run in the JVM."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V

#: Told one by one, as Java looks such classes up in a table and tries the parts of others in turn.
KEY_CHARACTERS = string.ascii_lowercase + string.digits + "#"

#: Words, or single signs that are neither words nor space: the same pattern holds in Spark, DuckDB and Python's classes.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"


def nfkc(text: Column) -> Column:
    """Compatibility composition, which no built-in has; only needed for text that is not in that form already."""

    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))

    return compose(text)


#: Texts of these characters alone are in compatibility form: ASCII, letters of Latin-1 and Latin Extended-A without
#: compatibility forms, and the quotes and dashes that normalize folds.
COMPOSED = r"^[\x00-\x7f\u00c0-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2018\u2019\u201c\u201d\u2013\u2014]*$"


def composed(df: DataFrame, column: str) -> DataFrame:
    """df with the column's texts in compatibility composition (NFKC), the form that every text operator begins from. Texts
    that are in it already are told by a pattern and never leave the JVM."""
    done = F.coalesce(F.col(column).rlike(COMPOSED), F.lit(True))
    return df.where(done).unionByName(df.where(~done).withColumn(column, nfkc(F.col(column))))


def normalize(text: Column) -> Column:
    """One space for each run of white space, straight quotes and hyphens, no white space around; null becomes empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\0‘’“”–— ", " ''\"\"-- ")
    return F.btrim(F.regexp_replace(plain, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences of a text. Periods of abbreviations and decimal signs end none; a decimal comma becomes a point."""
    names = "|".join(re.escape(a).replace("\\ ", " ") for a in V.ABBREVIATIONS)
    # the sign first and what is around it second, as signs are rare
    held = F.regexp_replace(normalize(text), rf"(?iU)\.(?<=\b(?:{names})\.)", "\u0001")
    held = F.regexp_replace(held, r"(?U)[.,](?<=\d[.,])(?=\d)", "\u0002")
    # normal text has no white space but the space, so that no wider class is needed
    parts = F.split(held, rf"\s*;\s+|{V.SENTENCE_END}")
    dotted = lambda p: F.replace(F.replace(p, F.lit("\u0001"), F.lit(".")), F.lit("\u0002"), F.lit("."))
    freed = F.transform(parts, lambda p: F.btrim(F.regexp_replace(dotted(p), f"(?U){V.BULLET}", "")))
    return F.filter(freed, lambda p: F.length(p) > 0)


def ensure_period(text: Column) -> Column:
    t = F.btrim(text)
    return F.when(t == "", F.lit("")).when(F.right(t, F.lit(1)).isin(".", "!", "?"), t).otherwise(F.concat(t, F.lit(".")))


def space_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def _named(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body reads it: inside a lambda nothing else sees to that."""
    return F.element_at(F.transform(F.array(value), body), 1)


def phrases_of(sentence: Column, split_conjunctions: bool = True) -> Column:
    """A sentence as one phrase, or cut at conjunctions where every part has a finite verb; parts of one word go."""
    whole = F.array(sentence)
    if split_conjunctions:
        clauses = lambda parts: (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(f"(?iU){V.CLAUSE_VERB}"))
        parts = F.transform(F.split(sentence, f"(?iU){V.CONJUNCTION}"), F.btrim)
        whole = F.when(F.contains(sentence, F.lit(",")), _named(parts, lambda p: F.when(clauses(p), p).otherwise(F.array(sentence)))).otherwise(whole)
    clean = F.transform(whole, lambda p: F.btrim(p, F.lit(" ;,")))
    return F.transform(F.filter(clean, lambda p: p.rlike(r"(?U)\S\s+\S")), ensure_period)


def phrases(text: Column, split_conjunctions: bool = True) -> Column:
    return F.flatten(F.transform(sentences(text), lambda s: phrases_of(s, split_conjunctions)))


def is_verifiable(phrase: Column) -> Column:
    return ~phrase.rlike(f"(?iU){V.NON_VERIFIABLE}")


def canonical(phrase: Column, mask_numbers: bool = True) -> Column:
    """Key of near-equal phrases: folded case, numbers as # (or marked, to keep teeth apart), ASCII letters and digits."""
    # all that normal form would change becomes a space below
    low = F.replace(F.lower(F.coalesce(phrase, F.lit(""))), F.lit("ß"), F.lit("ss"))
    low = F.regexp_replace(low, r"\d+(?:\.\d+)?", "#") if mask_numbers else F.regexp_replace(low, r"(?<!\d)\d{1,3}(?:\.\d+)?", " n$0 ")
    return F.btrim(F.regexp_replace(low, f"[^{KEY_CHARACTERS}]+", " "))


def capitalize_first(text: Column) -> Column:
    """The first letter in upper case, unless a digit comes before it."""
    t = F.ltrim(text)
    at = F.regexp_instr(t, F.lit(r"[\p{L}\p{Nd}]"))
    return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.upper(F.substring(t, at, F.lit(1))), F.substring(t, at + 1, F.length(t)))).otherwise(t)


def join_report(items: Column) -> Column:
    """Statements as one paragraph."""
    ready = F.transform(items, lambda s: capitalize_first(ensure_period(normalize(s))))
    return F.array_join(F.filter(ready, lambda s: s != ""), " ")


def finding_list(items: Column) -> Column:
    """Statements as a list, one a line."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def prompt(items: Column, instruction: str) -> Column:
    """Two turns (role, content): the instruction, and the list of findings to be told as a report."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(instruction)), turn("user", F.concat(F.lit("Findings:\n"), finding_list(items), F.lit("\n\nReport:"))))


def training_pairs(reports: DataFrame, text: str = "report", shuffled: bool = True, seed: int = 2026) -> DataFrame:
    """findings (the report's own phrases, two at least), report. Shuffled by a hash of seed, report and phrase, so reruns
    agree; equal phrases of a report stay, side by side."""
    found = reports.select(phrases(F.col(text)).alias("findings"), F.col(text).alias("report")).where(F.size("findings") >= 2)
    if not shuffled:
        return found
    keyed = F.transform("findings", lambda p: F.struct(F.xxhash64(F.lit(seed), F.col("report"), p).alias("k"), p.alias("p")))
    return found.select(F.transform(F.array_sort(keyed), lambda x: x["p"]).alias("findings"), "report")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\w+"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def ngrams(items: Column, n: int, separator: str = "\u0001") -> Column:
    """Runs of n items, in order, repeats kept; none if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.array_join(F.slice(items, i, F.lit(n)), separator))
    return F.when(F.size(items) >= n, runs).otherwise(F.array().cast("array<string>"))


def content_tokens(text: Column, stopwords: list[str]) -> Column:
    """Distinct word tokens without stop words."""
    words = F.filter(tokens(text), lambda t: t.rlike(r"^[\p{L}\p{N}]+$"))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in stopwords]))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two sets; two empty sets agree."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def group_of(case_id: Column) -> Column:
    """Leading letters in upper case, else UNKNOWN."""
    found = F.upper(F.regexp_extract(F.btrim(case_id), "^([A-Za-z]+)", 1))
    return F.when(found == "", F.lit("UNKNOWN")).otherwise(found)


def is_well_formed(text: Column) -> Column:
    t = F.btrim(text)
    balanced = F.length(F.replace(t, F.lit("("), F.lit(""))) == F.length(F.replace(t, F.lit(")"), F.lit("")))
    return (t != "") & ~t.rlike(f"(?iU){V.DANGLING}") & ~t.rlike(f"(?iU){V.BACK_REFERENCE}") & ~t.rlike(f"(?iU){V.UNTRANSLATED}") & balanced


def is_generic(text: Column) -> Column:
    return ~text.rlike(f"(?iU){V.DANGLING}") & ~text.rlike(f"(?U){V.TOOTH_NUMBER}") & ~text.rlike(f"(?U){V.BARE_TOOTH}")
