"""All queries of the library's own operators by name, with their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import concepts as C
from ..functions import fixed_values as V
from ..functions import text as T
from ..operators import additive as A
from ..operators import bank as B
from ..operators import entail as E
from ..operators import metrics as M
from ..operators import models as L
from ..operators import rank as R
from ..operators import search as S
from ..operators import select as X
from ..sources import cases as SRC
from ..sources.written import materialize
from . import statement_sql as Q
from . import told as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# --- captions: each document against the next one of its language ------------------------------------------------------

PAT = T.TOKEN
Q_PAIRS = "pairs AS (SELECT a.doc_id AS case_id, a.lang AS lang, a.text AS prediction, b.text AS reference FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND a.lang = b.lang)"
Q_TOK = f"{Q_PAIRS}, tok AS (SELECT case_id, lang, regexp_extract_all(lower(prediction), '{PAT}') AS p, regexp_extract_all(lower(reference), '{PAT}') AS r FROM pairs)"
Q_GRAMS = f"""{Q_TOK}, orders AS (SELECT unnest([1, 2, 3, 4]) AS n),
 grams AS (SELECT case_id, lang, n, 1 AS h, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i:i + n - 1], chr(1)))) AS gram FROM tok, orders
   UNION ALL SELECT case_id, lang, n, 0, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], chr(1)))) FROM tok, orders),
 counted AS (SELECT case_id, lang, n, gram, sum(h) AS h, sum(1 - h) AS t FROM grams GROUP BY ALL),
 found AS (SELECT case_id, lang, n, sum(least(h, t)) AS matches, sum(h) AS total FROM counted GROUP BY ALL)"""


def _q_bleu(by: str) -> str:
    k, g, eq = (f"{by}, ", f"GROUP BY {by}", f"USING ({by})") if by else ("", "", "ON true")
    num = ", ".join(f"sum(CASE WHEN n = {n} THEN matches ELSE 0 END) AS n{n}" for n in M.ORDERS)
    den = ", ".join(f"sum(greatest(1, len(p) - {n - 1})) AS d{n}" for n in M.ORDERS)
    logs = " + ".join(f"ln(CASE WHEN n{n} = 0 THEN 0.1 / d{n} ELSE n{n} / d{n}::DOUBLE END)" for n in M.ORDERS)
    return f"""{Q_GRAMS}, num AS (SELECT {k}{num} FROM found {g}), den AS (SELECT {k}{den}, sum(len(p)) AS hl, sum(len(r)) AS rl, count(*) AS cases FROM tok {g}),
 bleu AS (SELECT {k}cases, hl, rl, CASE WHEN n1 = 0 THEN 0.0 ELSE (CASE WHEN hl > rl THEN 1.0 ELSE exp(1.0 - rl / hl::DOUBLE) END) * exp(({logs}) / 4.0) END AS bleu_4 FROM den JOIN num {eq})"""


Q_METEOR = """pp AS (SELECT case_id, lang, unnest(p) AS token, generate_subscripts(p, 1) - 1 AS pos FROM tok), rr AS (SELECT case_id, unnest(r) AS token, generate_subscripts(r, 1) - 1 AS pos FROM tok),
 pk AS (SELECT *, row_number() OVER (PARTITION BY case_id, token ORDER BY pos) AS k FROM pp), rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, token ORDER BY pos) AS k FROM rr),
 met AS (SELECT pk.case_id, pk.pos AS pi, rk.pos AS ri FROM pk JOIN rk ON pk.case_id = rk.case_id AND pk.token = rk.token AND pk.k = rk.k),
 brk AS (SELECT case_id, CASE WHEN lag(ri) OVER (PARTITION BY case_id ORDER BY pi) + 1 = ri THEN 0 ELSE 1 END AS new FROM met),
 runs AS (SELECT case_id, count(*) AS matches, sum(new) AS chunks FROM brk GROUP BY case_id),
 base AS (SELECT case_id, lang, len(p) AS np, len(r) AS nr, coalesce(matches, 0) AS m, coalesce(chunks, 0) AS c FROM tok LEFT JOIN runs USING (case_id)),
 met2 AS (SELECT *, CASE WHEN np = 0 AND nr = 0 THEN 1.0 WHEN m = 0 THEN 0.0 ELSE 10 * (m / np::DOUBLE) * (m / nr::DOUBLE) / ((m / nr::DOUBLE) + 9 * (m / np::DOUBLE)) * (1 - 0.5 * pow(c / m::DOUBLE, 3)) END AS meteor FROM base)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), "lang", F.col("text").alias("reference"))
    return d.select("doc_id", "lang", F.col("text").alias("prediction")).join(nxt, ["doc_id", "lang"]).withColumnRenamed("doc_id", "case_id")


@query(f"WITH {_q_bleu('')} SELECT cases, hl AS prediction_tokens, rl AS reference_tokens, round(bleu_4, 6) AS bleu_4 FROM bleu")
def corpus_bleu4(spark, sf):
    return M.corpus_bleu(pairs(spark, sf)).withColumn("bleu_4", r6("bleu_4"))


@query(f"WITH {Q_TOK}, {Q_METEOR} SELECT case_id, m AS matches, c::BIGINT AS chunks, round(meteor, 6) AS meteor FROM met2")
def meteor_pairs(spark, sf):
    return M.meteor(pairs(spark, sf)).select("case_id", "matches", "chunks", r6("meteor").alias("meteor"))


@query(f"WITH {Q_TOK}, {Q_METEOR} SELECT count(*) AS cases, round(avg(meteor), 6) AS meteor FROM met2")
def meteor_mean(spark, sf):
    return M.meteor(pairs(spark, sf)).agg(F.count("*").alias("cases"), r6(F.avg("meteor")).alias("meteor"))


@query(
    f"""WITH {Q_GRAMS}, s AS (SELECT n, sum(matches) AS m, sum(total) AS t FROM found GROUP BY n), z AS (SELECT sum(len(p)) AS hl, sum(len(r)) AS rl, count(*) AS cases FROM tok)
 SELECT any_value(cases) AS cases, round((CASE WHEN any_value(hl) > any_value(rl) THEN 1.0 ELSE exp(1.0 - any_value(rl) / any_value(hl)::DOUBLE) END) * exp(sum(ln((m + 1) / (t + 1)::DOUBLE)) / 4), 6) AS bleu_4_proxy FROM s, z"""
)
def legacy_bleu_addone(spark, sf):
    return M.legacy_bleu(pairs(spark, sf)).withColumn("bleu_4_proxy", r6("bleu_4_proxy"))


def _q_rollup(tail: str) -> str:
    return f"WITH {_q_bleu('lang')}, {Q_METEOR}, mm AS (SELECT lang, avg(meteor) AS meteor FROM met2 GROUP BY lang), x AS (SELECT * FROM bleu JOIN mm USING (lang)) {tail}"


@query(_q_rollup("SELECT lang, cases, round(bleu_4, 6) AS bleu_4, round(meteor, 6) AS meteor, round((bleu_4 + meteor) / 2, 6) AS captioning FROM x"))
def metric_rollup_by_lang(spark, sf):
    s = M.caption_scores(pairs(spark, sf), ["lang"])
    return s.select("lang", "cases", *[r6(c).alias(c) for c in ("bleu_4", "meteor", "captioning")])


@query(_q_rollup("SELECT 'mean' AS how, count(*) AS groups, round(avg(bleu_4), 6) AS bleu_4, round(avg(meteor), 6) AS meteor FROM x UNION ALL SELECT 'worst', count(*), round(min(bleu_4), 6), round(min(meteor), 6) FROM x"))
def group_balanced_scores(spark, sf):
    s = M.caption_scores(pairs(spark, sf), ["lang"])
    both = [M.across_groups(s, how).withColumn("how", F.lit(how)) for how in ("mean", "worst")]
    return both[0].unionByName(both[1]).select("how", "groups", r6("bleu_4").alias("bleu_4"), r6("meteor").alias("meteor"))


# --- text --------------------------------------------------------------------------------------------------------------


@query(f"SELECT lang, count(*) AS docs, sum(len(t))::BIGINT AS tokens, round(quantile_cont(len(t), 0.5), 6) AS median FROM (SELECT lang, regexp_extract_all(lower(text), '{PAT}') AS t FROM documents) GROUP BY lang")
def tokens_profile(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.size(T.tokens(F.col("text"))).alias("n"))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), r6(F.percentile("n", 0.5)).alias("median"))


Q_NORM = r"""trim(regexp_replace(translate(text, '‘’“”–— ', '''''""-- '), '\s+', ' ', 'g'))"""
#: Abbreviation periods and decimals are guarded as in the library; both sides of a boundary get a mark, as RE2 looks around nothing.
Q_SENT = rf"""sent AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({Q_NORM},
 '(?i)(^|[^\p{{L}}\p{{N}}_])(approx|cf|dr|e\.g|et al|fig|i\.e|n|no|nr|prof|sig|vs)\.', '\1\2' || chr(1), 'g'), '(\d)[.,](\d)', '\1' || chr(2) || '\2', 'g'), '(\d)[.,](\d)', '\1' || chr(2) || '\2', 'g'), '\s*;\s+', chr(3), 'g'), '([.!?])\s+([A-Z0-9"''(\[])', '\1' || chr(3) || '\2', 'g'), chr(3)),
 lambda s: trim(regexp_replace(replace(replace(s, chr(1), '.'), chr(2), '.'), '^\s*(?:[-*•–—]|\(?\d{{1,2}}[.)])\s+', ''))), lambda s: len(s) > 0) AS s FROM documents)"""


@query(f"WITH {Q_SENT} SELECT doc_id, len(s)::BIGINT AS sentences, md5(array_to_string(s, '|')) AS digest FROM sent")
def sentence_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


_VERB = V.CLAUSE_VERB.removeprefix(r"\b").removesuffix(r"\b")
Q_PHRASE = rf"""ph AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS ord FROM sent),
 cut AS (SELECT doc_id, ord, sentence, list_transform(string_split(regexp_replace(sentence, '(?i),\s+(?:and|while|whereas)\s+((?:the|a|an|there|no|both|bilateral|left|right)(?:$|[^\p{{L}}\p{{N}}_]))', chr(4) || '\1', 'g'), chr(4)), lambda x: trim(x)) AS parts FROM ph),
 whole AS (SELECT doc_id, ord, CASE WHEN len(parts) > 1 AND len(list_filter(parts, lambda x: regexp_matches(x, '(?i)(^|[^\p{{L}}\p{{N}}_]){_VERB}($|[^\p{{L}}\p{{N}}_])'))) = len(parts) THEN parts ELSE [sentence] END AS parts FROM cut),
 each AS (SELECT doc_id, ord * 1000 + generate_subscripts(parts, 1) AS ord, trim(unnest(parts), ' ;,') AS c FROM whole),
 phrase AS (SELECT doc_id, ord, CASE WHEN right(c, 1) IN ('.', '!', '?') THEN c ELSE c || '.' END AS phrase FROM each WHERE len(list_filter(string_split_regex(c, '\s+'), lambda w: w <> '')) >= 2)"""


@query(f"WITH {Q_SENT}, {Q_PHRASE} SELECT doc_id, count(*) AS phrases, sum(len(phrase))::BIGINT AS characters FROM phrase GROUP BY doc_id")
def phrase_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(T.phrases(F.col("text"))).alias("phrase"))
    return d.groupBy("doc_id").agg(F.count("*").alias("phrases"), F.sum(F.length("phrase")).alias("characters"))


def _q_canonical(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '\d+(?:\.\d+)?', '#', 'g'), '[^a-z0-9#\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_q_canonical(Q_NORM)}) AS canonical FROM documents")
def canonical_masked(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.canonical(F.col("text")).cast("binary")).alias("canonical"))


def _doc_phrases(spark, sf) -> DataFrame:
    """Cases are documents; a phrase's order is its place in the document."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.array("text").alias("reports"))
    return B.case_phrases(d)


Q_CASE_PHRASES = rf"""{Q_SENT}, {Q_PHRASE}, cp AS (SELECT doc_id AS case_id, ord, phrase, {_q_canonical('phrase')} AS canonical FROM phrase WHERE len(list_filter(string_split_regex(phrase, '\s+'), lambda w: w <> '')) <= 60
 AND NOT regexp_matches(phrase, '(?i){V.NON_VERIFIABLE}')), cq AS (SELECT * FROM cp WHERE canonical <> '')"""


@query(f"WITH {Q_CASE_PHRASES} SELECT canonical, count(DISTINCT case_id) AS support, count(*) AS places, round(count(DISTINCT case_id) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS prevalence FROM cq GROUP BY canonical HAVING count(DISTINCT case_id) >= 2")
def phrase_support_prevalence(spark, sf):
    n = table(spark, sf, "documents").agg(F.count("*").alias("n"))
    s = B.support(_doc_phrases(spark, sf)).where("support >= 2").join(n)
    return s.select("canonical", "support", "places", r6(F.col("support") / F.col("n")).alias("prevalence"))


@query(f"WITH {Q_CASE_PHRASES}, f AS (SELECT canonical, phrase, count(*) AS n, min((case_id, ord)) AS seen FROM cq GROUP BY ALL) SELECT canonical, arg_min(phrase, (-n, seen)) AS phrase FROM f GROUP BY canonical")
def canonical_modal_form(spark, sf):
    return B.modal_form(_doc_phrases(spark, sf))


@query(f"WITH {Q_CASE_PHRASES}, s AS (SELECT canonical, count(DISTINCT case_id) AS support FROM cq GROUP BY canonical) SELECT canonical, support FROM s ORDER BY support DESC, canonical LIMIT 20")
def top_statements(spark, sf):
    return B.support(_doc_phrases(spark, sf)).select("canonical", "support").orderBy(F.desc("support"), "canonical").limit(20)


# --- statements: benchmark items as the bank, documents as cases -------------------------------------------------------

_STOP = "['" + "','".join(V.STOPWORDS_STATEMENT) + "']"
Q_WORDS = "list_distinct(list_filter(regexp_extract_all({0}, '[a-z0-9]+'), lambda w: NOT list_contains(" + _STOP + ", w)))"
Q_JACCARD = f"""a AS (SELECT doc_id, {Q_WORDS.format(_q_canonical(Q_NORM))} AS w FROM documents), b AS (SELECT item_id, {Q_WORDS.format(_q_canonical(Q_NORM))} AS w FROM benchmark),
 met AS (SELECT doc_id, item_id, count(*) AS c FROM (SELECT doc_id, unnest(w) AS t FROM a) JOIN (SELECT item_id, unnest(w) AS t FROM b) USING (t) GROUP BY ALL),
 sim AS (SELECT doc_id, item_id, c / (len(a.w) + len(b.w) - c)::DOUBLE AS s FROM met JOIN a USING (doc_id) JOIN b USING (item_id))"""


def _described(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.content_tokens(T.canonical(F.col("text")), V.STOPWORDS_STATEMENT).alias("words"), F.array().cast("array<string>").alias("concepts"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("proto"), T.content_tokens(T.canonical(F.col("text")), V.STOPWORDS_STATEMENT).alias("words"), F.array().cast("array<string>").alias("concepts"))
    return docs, items


@query(f"WITH {Q_JACCARD}, m AS (SELECT doc_id, max((s, item_id)) AS m FROM sim WHERE s >= 0.1 GROUP BY doc_id) SELECT d.doc_id, m.m[2] AS item_id, round(m.m[1], 6) AS similarity FROM documents d LEFT JOIN m USING (doc_id)")
def content_jaccard_best(spark, sf):
    docs, items = _described(spark, sf)
    return B.assign(docs, items, 0.1).select(F.col("id").alias("doc_id"), F.col("proto").alias("item_id"), r6("similarity").alias("similarity"))


@query(f"WITH {Q_JACCARD}, m AS (SELECT doc_id, max((s, item_id)) AS m FROM sim WHERE s >= 0.1 GROUP BY doc_id) SELECT d.source AS case_id, m.m[2] AS proto FROM documents d JOIN m USING (doc_id) GROUP BY ALL")
def label_matrix(spark, sf):
    docs, items = _described(spark, sf)
    got = B.assign(docs, items, 0.1).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("case_id")), "id")
    return B.labels(got)


@query(f"WITH {Q_JACCARD}, m AS (SELECT DISTINCT doc_id, 1 AS hit FROM sim WHERE s >= 0.1), c AS (SELECT source, avg(coalesce(hit, 0)) AS share FROM documents LEFT JOIN m USING (doc_id) GROUP BY source) SELECT round(avg(share), 6) AS coverage, count(*) AS cases FROM c")
def label_coverage(spark, sf):
    docs, items = _described(spark, sf)
    d = table(spark, sf, "documents")
    got = B.assign(docs, items, 0.1).join(d.select(F.col("doc_id").alias("id"), F.col("source").alias("case_id")), "id")
    return B.coverage(d.select(F.col("source").alias("case_id")).distinct(), got).withColumn("coverage", r6("coverage"))


# --- statements told for each document ----------------------------------------------------------------------------------

STATEMENTS = [
    "The right maxillary sinus shows mucosal thickening of 1.2 cm.",
    "No periapical lesion is seen at tooth 36.",
    "Absence from the arch of teeth 35, 36 and 37.",
    "Left and right mandibular canals are regular, with a predominantly lingual course.",
    "Impacted tooth 48 in contact with the mandibular canal.",
    "The maxilla is partially included in the scan and is not assessable.",
    "Composite fillings on teeth 36 and 46.",
    "Complete edentulism of the mandible.",
    "Possible cyst measuring 4,5 mm near element 22.",
    "The condyles are not included in the acquired volume.",
    "No significant abnormality.",
    "The patient was scanned twice.",
    "Tooth 36 has an endodontic treatment.",
    "Canal course is predominantly buccal.",
    "A periapical lesion is visible at tooth 36.",
    "Impacted tooth 48 in contact with the mandibular canal, suspected cyst of 3 mm.",
]

_Q_STATEMENTS = D.SQL


def statements(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_mentions(D.statements(spark, sf))


@query(
    f"WITH {_Q_STATEMENTS}, {Q.mentions('st')} SELECT id, concept, polarity, laterality, array_to_string(teeth, ',') AS teeth, array_to_string(measurements, ',') AS mm FROM mention"
)
def mentions_inline(spark, sf):
    return statements(spark, sf).select("id", F.explode("mentions").alias("m")).select("id", "m.concept", "m.polarity", "m.laterality", F.array_join(F.transform("m.teeth", lambda t: t.cast("string")), ",").alias("teeth"), F.array_join(F.transform("m.measurements", lambda t: t.cast("string")), ",").alias("mm"))




@query(
    rf"""WITH {_Q_STATEMENTS} SELECT id, CASE WHEN regexp_matches(text, '(?i){V.BILATERAL}') OR (regexp_matches(text, '(?i){V.LEFT}') AND regexp_matches(text, '(?i){V.RIGHT}')) THEN 'bilateral'
 WHEN regexp_matches(text, '(?i){V.LEFT}') THEN 'left' WHEN regexp_matches(text, '(?i){V.RIGHT}') THEN 'right' ELSE 'unspecified' END AS side,
 array_to_string(list_sort(list_distinct(CASE WHEN len(regexp_extract_all(text, '{V.TOOTH_NUMBER}', 1)) > 0 THEN regexp_extract_all(array_to_string(regexp_extract_all(text, '{V.TOOTH_NUMBER}', 1), ' '), '\d{{2}}') ELSE regexp_extract_all(text, '{V.BARE_TOOTH}', 1) END)), ',') AS teeth,
 NOT regexp_matches(text, '(?i){V.NON_VERIFIABLE}') AS verifiable FROM st"""
)
def qualifiers_inline(spark, sf):
    s = statements(spark, sf)
    return s.select("id", C.laterality(F.col("text")).alias("side"), F.array_join(F.transform(C.teeth(F.col("text")), lambda t: t.cast("string")), ",").alias("teeth"), T.is_verifiable(F.col("text")).alias("verifiable"))


@query(
    rf"""WITH {_Q_STATEMENTS}, {Q.mentions('st')}, f AS (SELECT id, arg_min(section, ord) AS section FROM mention GROUP BY id), s AS (SELECT id, text, coalesce(section, 'other') AS section FROM st LEFT JOIN f USING (id))
 SELECT id, section, list_position({Q.listed(V.SECTIONS)}, section) - 1 AS rank, trim(text) <> '' AND NOT regexp_matches(trim(text), {Q.ignoring_case(V.DANGLING)}) AND NOT regexp_matches(text, {Q.ignoring_case(V.BACK_REFERENCE)}) AND NOT regexp_matches(text, {Q.ignoring_case(V.UNTRANSLATED)})
  AND len(replace(text, '(', '')) = len(replace(text, ')', '')) AS well_formed, NOT regexp_matches(text, {Q.ignoring_case(V.DANGLING)}) AND NOT regexp_matches(text, {Q.quoted(V.TOOTH_NUMBER)}) AND NOT regexp_matches(text, {Q.quoted(V.BARE_TOOTH)}) AS generic FROM s"""
)
def sections_inline(spark, sf):
    return statements(spark, sf).select("id", C.section(F.col("text")).alias("section"), C.section_rank(C.section(F.col("text"))).alias("rank"), T.is_well_formed(F.col("text")).alias("well_formed"), T.is_generic(F.col("text")).alias("generic"))


_Q_PROFILE = f"{_Q_STATEMENTS}, {Q.mentions('st')}, pf AS (SELECT case_id, concept, arg_max(polarity, CASE polarity WHEN 'present' THEN 3 WHEN 'uncertain' THEN 2 ELSE 1 END) AS polarity FROM mention JOIN st USING (id) GROUP BY ALL)"


@query(f"WITH {_Q_PROFILE} SELECT case_id, concept, polarity FROM pf")
def concept_profile_inline(spark, sf):
    return C.profile(statements(spark, sf))


@query(
    f"""WITH {_Q_PROFILE}, d AS (SELECT case_id, concept, a.polarity AS was, b.polarity AS is_ FROM pf a FULL JOIN (SELECT case_id - 1 AS case_id, concept, polarity FROM pf) b USING (case_id, concept))
 SELECT case_id, coalesce(string_agg(concept, ',' ORDER BY concept) FILTER (was IS NULL), '') AS added, coalesce(string_agg(concept, ',' ORDER BY concept) FILTER (is_ IS NULL), '') AS dropped, coalesce(string_agg(concept, ',' ORDER BY concept) FILTER (was <> is_), '') AS flipped FROM d GROUP BY case_id"""
)
def faithfulness_diff(spark, sf):
    """Each case's profile against the next case's."""
    told = C.profile(statements(spark, sf))
    return C.profile_changes(told, told.withColumn("case_id", F.col("case_id") - 1)).select("case_id", *[F.array_join(c, ",").alias(c) for c in ("added", "dropped", "flipped")])


@query(
    f"WITH {_Q_STATEMENTS}, {Q.signatures('st')}, w AS (SELECT sig.*, case_id FROM sig JOIN st USING (id)) SELECT * FROM (SELECT a.id AS a, b.id AS b, round({Q.ENTAILMENT}, 6) AS score FROM w a JOIN w b ON a.case_id = b.case_id - 1) WHERE score > 0"
)
def entailment_inline(spark, sf):
    """How far the next case's statements support a case's."""
    s = E.signed(D.statements(spark, sf).withColumnRenamed("text", "phrase"))
    a, b = s.select("case_id", F.col("id").alias("a"), F.col("sig").alias("sa")), s.select((F.col("case_id") - 1).alias("case_id"), F.col("id").alias("b"), F.col("sig").alias("sb"))
    return a.join(b, "case_id").select("a", "b", r6(E.entailment(F.col("sa"), F.col("sb"))).alias("score")).where("score > 0")


_Q_NEXT_TURN = """documents AS (SELECT conv_id * 200 + turn * 2 AS doc_id, text FROM conversations WHERE (conv_id, turn + 1) IN (SELECT (conv_id, turn) FROM conversations)
 UNION ALL SELECT conv_id * 200 + (turn - 1) * 2 + 1, text FROM conversations WHERE (conv_id, turn - 1) IN (SELECT (conv_id, turn) FROM conversations))"""


def _next_turns(spark, sf) -> DataFrame:
    """Each turn of a conversation against the next one; case_id is a hundred times the conversation, and the turn."""
    c = table(spark, sf, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return c.withColumnRenamed("text", "prediction").join(after, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("case_id"), "prediction", "reference")


_Q_ENTAILED = f"""{_Q_NEXT_TURN}, {Q_SENT}, {Q_PHRASE}, vp AS MATERIALIZED (SELECT doc_id // 2 AS case_id, doc_id % 2 AS side, phrase FROM phrase WHERE NOT regexp_matches(phrase, {Q.ignoring_case(V.NON_VERIFIABLE)})),
 st AS MATERIALIZED (SELECT row_number() OVER () AS id, phrase AS text FROM (SELECT DISTINCT phrase FROM vp)), {Q.signatures('st')}, v AS (SELECT case_id, side, id FROM vp JOIN st ON phrase = text),
 good AS (SELECT DISTINCT x.case_id, x.side, x.id FROM v x JOIN v y ON x.case_id = y.case_id AND x.side <> y.side JOIN sig a ON a.id = x.id JOIN sig b ON b.id = y.id WHERE {Q.ENTAILMENT} >= {V.ENTAILED_FROM}),
 c AS (SELECT v.case_id, count(*) FILTER (side = 0) AS np, count(*) FILTER (side = 1) AS nr, count(*) FILTER (side = 0 AND good.id IS NOT NULL) AS gp, count(*) FILTER (side = 1 AND good.id IS NOT NULL) AS gr FROM v LEFT JOIN good USING (case_id, side, id) GROUP BY ALL),
 z AS (SELECT d.case_id, coalesce(np, 0) AS np, coalesce(nr, 0) AS nr, CASE WHEN coalesce(np, 0) = 0 THEN 0.0 ELSE gp / np::DOUBLE END AS p, CASE WHEN coalesce(nr, 0) = 0 THEN 0.0 ELSE gr / nr::DOUBLE END AS r FROM (SELECT DISTINCT doc_id // 2 AS case_id FROM documents) d LEFT JOIN c USING (case_id))"""


@query(
    f"""WITH {_Q_ENTAILED} SELECT case_id, np AS candidate_count, nr AS reference_count, round(p, 6) AS logical_precision, round(r, 6) AS logical_recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS logical_f1 FROM z"""
)
def entailment_pr_f1(spark, sf):
    s = E.clinical_scores(_next_turns(spark, sf))
    return s.select("case_id", "candidate_count", "reference_count", *[r6(x).alias(x) for x in ("logical_precision", "logical_recall", "logical_f1")])


_Q_TURN_PAIRS = "pairs AS (SELECT a.doc_id // 2 AS case_id, 'x' AS lang, a.text AS prediction, b.text AS reference FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND a.doc_id % 2 = 0)"


@query(
    f"""WITH {_Q_ENTAILED}, {_q_bleu('').replace(Q_PAIRS, _Q_TURN_PAIRS)}, {Q_METEOR}, mm AS (SELECT avg(meteor) AS meteor FROM met2), pr AS (SELECT avg(p) AS p, avg(r) AS r FROM z),
 f AS (SELECT cases, bleu_4, meteor, p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS clinical FROM bleu, mm, pr)
 SELECT cases, round(bleu_4, 6) AS bleu_4, round(meteor, 6) AS meteor, round(p, 6) AS logical_precision, round(r, 6) AS logical_recall, round(clinical, 6) AS clinical, round(0.8::DOUBLE * clinical + 0.2::DOUBLE * (bleu_4 + meteor) / 2, 6) AS final FROM f"""
)
def final_score(spark, sf):
    pairs = _next_turns(spark, sf)
    s = M.challenge_scores(pairs.select("case_id", "prediction"), pairs.select("case_id", F.array("reference").alias("references")))
    return s.select("cases", *[r6(c).alias(c) for c in ("bleu_4", "meteor", "logical_precision", "logical_recall", "clinical", "final")])


_Q_TOLD_PAIRS = f"{_Q_STATEMENTS.replace('st AS', 'told AS')}, told_report AS MATERIALIZED (SELECT case_id, string_agg(text, ' ' ORDER BY k) AS report FROM told GROUP BY case_id), documents AS (SELECT case_id * 2 AS doc_id, report AS text FROM told_report WHERE case_id + 1 IN (SELECT case_id FROM told_report) UNION ALL SELECT case_id * 2 - 1, report FROM told_report WHERE case_id - 1 IN (SELECT case_id FROM told_report))"
_Q_TOLD_ENTAILED = _Q_ENTAILED.replace(_Q_NEXT_TURN, _Q_TOLD_PAIRS)


def _next_reports(spark, sf) -> DataFrame:
    """Each case's told report against the next one's: case_id, prediction, reference."""
    r = D.reports(spark, sf)
    return r.withColumnRenamed("report", "prediction").join(r.select((F.col("case_id") - 1).alias("case_id"), F.col("report").alias("reference")), "case_id")


@query(
    f"""WITH {_Q_TOLD_ENTAILED} SELECT case_id, np AS candidate_count, nr AS reference_count, round(p, 6) AS logical_precision, round(r, 6) AS logical_recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS logical_f1 FROM z"""
)
def told_entailment_f1(spark, sf):
    s = E.clinical_scores(_next_reports(spark, sf))
    return s.select("case_id", "candidate_count", "reference_count", *[r6(x).alias(x) for x in ("logical_precision", "logical_recall", "logical_f1")])


@query(
    f"""WITH {_Q_TOLD_ENTAILED}, {_q_bleu('').replace(Q_PAIRS, _Q_TURN_PAIRS)}, {Q_METEOR}, mm AS (SELECT avg(meteor) AS meteor FROM met2), pr AS (SELECT avg(p) AS p, avg(r) AS r FROM z),
 f AS (SELECT cases, bleu_4, meteor, p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS clinical FROM bleu, mm, pr)
 SELECT cases, round(bleu_4, 6) AS bleu_4, round(meteor, 6) AS meteor, round(p, 6) AS logical_precision, round(r, 6) AS logical_recall, round(clinical, 6) AS clinical, round(0.8::DOUBLE * clinical + 0.2::DOUBLE * (bleu_4 + meteor) / 2, 6) AS final FROM f"""
)
def told_final_score(spark, sf):
    pairs = _next_reports(spark, sf)
    s = M.challenge_scores(pairs.select("case_id", "prediction"), pairs.select("case_id", F.array("reference").alias("references")))
    return s.select("cases", *[r6(c).alias(c) for c in ("bleu_4", "meteor", "logical_precision", "logical_recall", "clinical", "final")])


@query(
    f"WITH {_Q_STATEMENTS}, {Q.conflicts('st')} SELECT case_id, i, j, reason FROM conflict"
)
def conflict_pairs(spark, sf):
    return X.conflict_pairs(statements(spark, sf), ["case_id"])


@query(
    f"WITH {_Q_STATEMENTS}, {Q.mentions('st')}, own AS (SELECT mention.*, case_id FROM mention JOIN st USING (id)) SELECT DISTINCT a.case_id, a.id AS i, b.id AS j FROM own a JOIN own b USING (case_id, concept) WHERE a.id < b.id AND a.polarity <> b.polarity AND a.polarity <> 'uncertain' AND b.polarity <> 'uncertain'"
)
def contradiction_pairs(spark, sf):
    return X.contradictions(statements(spark, sf).withColumnRenamed("id", "proto"), ["case_id"])


@query(
    f"""WITH RECURSIVE {_Q_STATEMENTS}, {Q.conflicts('st')}, k AS MATERIALIZED (SELECT id, st.case_id, st.k AS at, sig.text, CASE WHEN n > 0 THEN '{{"concepts":["' || array_to_string(pairs, '","') || '"],"side":"' || side || '","teeth":[' || array_to_string(teeth, ',') || ']}}' END AS key FROM sig JOIN st USING (id)),
 foe AS MATERIALIZED (SELECT id, list(other) AS foes FROM (SELECT i AS id, j AS other FROM conflict UNION ALL SELECT j, i FROM conflict) GROUP BY id),
 walk(case_id, step, kept, keys) AS (SELECT DISTINCT case_id, -1, []::BIGINT[], []::VARCHAR[] FROM k
  UNION ALL SELECT w.case_id, w.step + 1, CASE WHEN stays THEN list_append(w.kept, x.id) ELSE w.kept END, CASE WHEN stays AND x.key IS NOT NULL THEN list_append(w.keys, x.key) ELSE w.keys END
  FROM walk w JOIN k x ON x.case_id = w.case_id AND x.at = w.step + 1 LEFT JOIN foe f ON f.id = x.id, LATERAL (SELECT NOT coalesce(list_contains(w.keys, x.key), false) AND NOT coalesce(list_has_any(w.kept, f.foes), false) AS stays))
 SELECT k.case_id, k.id AS position, k.key, k.text FROM k JOIN walk w ON w.case_id = k.case_id AND w.step = {D.PER_CASE - 1} WHERE list_contains(w.kept, k.id)"""
)
def consistent_subset(spark, sf):
    s = statements(spark, sf)
    keyed = s.select("case_id", F.col("id").alias("position"), F.to_json(C.assertion_key(F.col("mentions"))).alias("key"), "text")
    return X.consistent_subset(keyed, X.conflict_pairs(s, ["case_id"]))


# --- selection ---------------------------------------------------------------------------------------------------------


@query(f"SELECT md5(canonical) AS key, array_to_string(list_sort(list(doc_id)), ',') AS positions FROM (SELECT doc_id, {_q_canonical(Q_NORM)} AS canonical FROM documents) WHERE canonical <> '' GROUP BY canonical HAVING count(*) > 1")
def redundancy_groups(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("position"), F.nullif(T.canonical(F.col("text")), F.lit("")).alias("key"))
    return X.redundant_groups(d).select(F.md5(F.col("key").cast("binary")).alias("key"), F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY {_q_canonical(Q_NORM)} ORDER BY len(text) DESC, conv_id * 1000 + turn) AS r FROM conversations) WHERE r = 1")
def dedup_best(spark, sf):
    c = table(spark, sf, "conversations").withColumn("position", F.col("conv_id") * 1000 + F.col("turn")).withColumn("key", T.canonical(F.col("text"))).withColumn("n", F.length("text"))
    return X.deduplicate(c, score="n").select("conv_id", "turn")


def _scores(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("case_id"), F.posexplode("embedding").alias("proto", "x"))
    return e.select("case_id", "proto", F.round(1 / (1 + F.exp(-F.col("x").cast("double"))), 5).alias("p"))


Q_SCORES = "sc AS (SELECT vec_id AS case_id, generate_subscripts(embedding, 1) - 1 AS proto, unnest(embedding) AS x FROM embeddings), pr AS (SELECT case_id, proto, round(1 / (1 + exp(-x::DOUBLE)), 5) AS p FROM sc)"


Q_CHOSEN = f"WITH {Q_SCORES}, m AS (SELECT case_id, proto, p::FLOAT - 0.6::FLOAT AS margin FROM pr), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY margin DESC, proto) AS rn, sum((margin >= 0)::INT) OVER (PARTITION BY case_id) AS n FROM m) SELECT case_id, proto FROM r WHERE (margin >= 0 AND rn <= 6) OR (n < 2 AND rn <= 2)"


@query(Q_CHOSEN)
def threshold_select(spark, sf):
    s = _scores(spark, sf)
    t = spark.range(64).select(F.col("id").cast("int").alias("proto"), F.lit(0.6).alias("thr"))
    return X.threshold_select(s, t, 2, 6).where("chosen").select("case_id", "proto")


@query(
    f"""WITH RECURSIVE ch AS ({Q_CHOSEN}), px AS (SELECT vec_id AS case_id, generate_subscripts(embedding, 1) - 1 AS proto, unnest(embedding) AS x FROM embeddings), c AS (SELECT case_id, proto, round(1 / (1 + exp(-x::DOUBLE)), 5) AS p FROM ch JOIN px USING (case_id, proto)),
 pair AS (SELECT a.case_id, a.proto AS i, b.proto AS j, a.p >= b.p AS stays, row_number() OVER (PARTITION BY a.case_id ORDER BY a.proto) AS k FROM c a JOIN c b ON a.case_id = b.case_id AND b.proto = a.proto + 1),
 walk(case_id, k, gone) AS (SELECT DISTINCT case_id, 0::BIGINT, []::BIGINT[] FROM c UNION ALL SELECT w.case_id, pair.k, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, CASE WHEN stays THEN j ELSE i END) END FROM walk w JOIN pair ON pair.case_id = w.case_id AND pair.k = w.k + 1),
 done AS (SELECT case_id, arg_max(gone, k) AS gone FROM walk GROUP BY case_id) SELECT case_id, proto, p FROM c JOIN done USING (case_id) WHERE NOT list_contains(gone, proto)"""
)
def resolve_conflicts(spark, sf):
    chosen = threshold_select(spark, sf).join(_scores(spark, sf), ["case_id", "proto"])
    foes = spark.range(0, 63).select(F.col("id").cast("int").alias("i"), (F.col("id") + 1).cast("int").alias("j"))
    return X.resolve(chosen.select("case_id", "proto", "p"), foes)


_GATE = [(k - 4) / 4.0 for k in range(8)]


@query("SELECT vec_id AS case_id, round(1 / (1 + exp(-(" + " + ".join(f"({w}) * embedding[{k + 1}]::DOUBLE / 2.0" for k, w in enumerate(_GATE)) + " + 0.1))), 6) AS p FROM embeddings")
def logistic_gate(spark, sf):
    e = table(spark, sf, "embeddings")
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    f = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("case_id"), r6(X.gate_probability(f, lit(_GATE), lit([0] * 8), lit([2] * 8), F.lit(0.1))).alias("p"))


_Q_GATED = ", ".join(f"({k}, '{t}', {0.5 * (k % 3 - 1)})" for k, t in enumerate(STATEMENTS))


@query(
    f"""WITH st(proto, text, w) AS (VALUES {_Q_GATED}), x AS (SELECT vec_id AS case_id, list_sum(list_transform(embedding, lambda v: v::DOUBLE)) AS s FROM embeddings)
 SELECT case_id, string_agg(text, ' ' ORDER BY proto) AS report FROM x, st WHERE proto < 3 OR 1 / (1 + exp(-greatest(-60, least(60, w * s)))) >= 0.5 GROUP BY case_id"""
)
def gated_reports(spark, sf):
    cases = table(spark, sf, "embeddings").select(F.col("vec_id").alias("case_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    rows = [(k, t, k, k < 3, 0.5 * (k % 3 - 1), 0.0, 0.5) for k, t in enumerate(STATEMENTS)]
    bank = spark.createDataFrame(rows, "proto int, text string, position int, core boolean, w double, intercept double, threshold double")
    dims = cases.select(F.max(F.size("features")).alias("d"))
    whole = bank.join(dims).select("*", F.array_repeat("w", F.col("d")).alias("weights"), F.array_repeat(F.lit(0.0), F.col("d")).alias("mean"), F.array_repeat(F.lit(1.0), F.col("d")).alias("scale"))
    return X.gated_reports(cases, whole.drop("w", "d")).select("case_id", "report")


# --- cases, joins, records ---------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'complete' WHEN l.doc_id IS NULL THEN 'volume_only' ELSE 'report_only' END AS status, count(*) AS cases, array_to_string(list_sort(list(coalesce(d.doc_id, l.doc_id)))[1:20], ',') AS examples FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def integrity_profile(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.col("source").alias("volume"))
    r = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), F.array(F.lit("report")).alias("report_paths"))
    p = SRC.integrity_profile(d.join(r, "case_id", "full_outer"))
    return p.select("status", "cases", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query("SELECT source || '-' || doc_id AS case_id, upper(regexp_extract(source, '^([A-Za-z]+)', 1)) AS center, n_chars AS report_count FROM documents")
def manifest_projection(spark, sf):
    d = table(spark, sf, "documents")
    case = F.concat_ws("-", "source", "doc_id")
    return d.select(case.alias("case_id"), T.group_of(case).alias("center"), F.col("n_chars").alias("report_count"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def json_records(spark, sf):
    return table(spark, sf, "events").withColumn("r", SRC.nested_record(F.col("props"), "k bigint")).select("event_id", "r.k", "event_type")


@query("SELECT 'documents' AS variant, doc_id, n_chars, NULL::INTEGER AS quality FROM documents UNION ALL SELECT 'labels', doc_id, NULL, quality FROM labels")
def union_variants(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels").select("doc_id", "quality")  # noqa: E741
    return SRC.results_table({"documents": d, "labels": l}).select("variant", "doc_id", "n_chars", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def stale_cases(spark, sf):
    requested = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.lit(1).alias("version"))
    return SRC.stale_caches(requested, table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("version")), ["version"]).select(F.col("case_id").alias("doc_id"))


# --- consensus: conversations as cases, turns as reports ----------------------------------------------------------------


def _turn_pairs(spark, sf) -> DataFrame:
    """All ordered pairs of one conversation's turns (2 to 8 turns each)."""
    c = table(spark, sf, "conversations")
    a, b = c.select("conv_id", F.col("turn").alias("i"), F.col("text").alias("prediction")), c.select("conv_id", F.col("turn").alias("j"), F.col("text").alias("reference"))
    return a.join(b, "conv_id").where("i <> j").withColumn("case_id", (F.col("conv_id") * 100 + F.col("i")) * 100 + F.col("j"))


Q_TURNS = f"c AS (SELECT conv_id, turn, text, len(text) AS n FROM conversations), pairs AS (SELECT (a.conv_id * 100 + a.turn) * 100 + b.turn AS case_id, 'x' AS lang, a.text AS prediction, b.text AS reference FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn <> b.turn), tok AS (SELECT case_id, lang, regexp_extract_all(lower(prediction), '{PAT}') AS p, regexp_extract_all(lower(reference), '{PAT}') AS r FROM pairs)"


@query(f"WITH {Q_TURNS}, {Q_METEOR}, s AS (SELECT case_id // 10000 AS conv_id, (case_id // 100) % 100 AS i, round(avg(meteor), 9) AS m, any_value(np) AS n FROM met2 GROUP BY 1, 2) SELECT conv_id, arg_max(i, (m, n, -i)) AS chosen FROM s GROUP BY conv_id")
def medoid_reference(spark, sf):
    met = M.meteor(_turn_pairs(spark, sf), ["conv_id", "i", "j", "case_id"])
    return R.medoid(met.select("conv_id", "i", "j", F.col("meteor").alias("u"), F.col("np").alias("n")), ["conv_id"])


@query(
    rf"""WITH t AS (SELECT conv_id, turn, text, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')) AS w FROM conversations),
 s AS (SELECT a.conv_id, a.turn AS i, any_value(len(a.text)) AS n, round(avg(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE END), 9) AS s FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY 1, 2)
 SELECT conv_id, arg_max(i, (s, n, -i)) AS chosen FROM s GROUP BY conv_id"""
)
def consensus_jaccard(spark, sf):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return R.consensus(table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("i"), F.length("text").alias("n"), words("text").alias("words")), ["conv_id"])


@query(
    f"""WITH {_q_bleu("case_id").replace(Q_TOK, Q_TURNS)}, {Q_METEOR}, u AS (SELECT case_id // 10000 AS conv_id, (case_id // 100) % 100 AS i, CAST((bleu_4 + meteor) / 2 AS DECIMAL(12, 9)) AS u FROM met2 JOIN bleu USING (case_id)),
 s AS (SELECT conv_id, i, sum(u) / count(*) AS score FROM u GROUP BY ALL) SELECT conv_id, arg_max(i, (score, -i)) AS chosen, round(max(score), 6) AS score FROM s GROUP BY conv_id"""
)
def mbr_consensus(spark, sf):
    p = _turn_pairs(spark, sf)
    keys = ["conv_id", "i", "j"]
    # decimals, so that equal turns tie whatever the order of the sum
    u = M.caption_scores(p, keys).select(*keys, F.col("captioning").cast("decimal(12,9)").alias("u"), F.lit(1).alias("weight"))
    return R.weighted_consensus(u, ["conv_id"]).withColumn("score", r6("score"))


# --- splits and models ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS case_id, source, ((row_number() OVER (PARTITION BY source ORDER BY md5('2026:' || doc_id), doc_id) - 1 + CAST('0x' || substr(md5('2026:' || source), 1, 8) AS BIGINT)) % 5)::INTEGER AS fold FROM documents")
def fold_round_robin(spark, sf):
    return L.stratified_folds(table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "source"), "source")


@query("WITH g AS (SELECT source AS held, row_number() OVER (ORDER BY source) - 1 AS split FROM (SELECT DISTINCT source FROM documents)) SELECT split::INTEGER AS split, CASE WHEN source = held THEN 'validation' ELSE 'train' END AS role, count(*) AS cases FROM documents, g GROUP BY ALL")
def leave_one_group_out(spark, sf):
    s = L.leave_one_group_out(table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "source"), "source")
    return s.groupBy("split", "role").agg(F.count("*").alias("cases"))


@query("WITH q AS (SELECT vec_id, embedding FROM embeddings), d AS (SELECT q.vec_id AS query, e.vec_id AS item, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE)) / 64.0 AS d FROM q, embeddings e WHERE q.vec_id <> e.vec_id) SELECT query, arg_min(item, (d, item)) AS match, round(min(d), 6) AS distance FROM d GROUP BY query")
def nearest_neighbour(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    return L.nearest(q, e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")), 64, others=True).select("query", "match", r6("distance").alias("distance"))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS i FROM orders) SELECT 'o_totalprice' AS \"column\", round(m, 6) AS median, round(CASE WHEN i > 1e-6 THEN i ELSE 1.0 END, 6) AS scale FROM q")
def robust_standardize(spark, sf):
    return L.robust_stats(table(spark, sf, "orders"), ["o_totalprice"]).select("column", r6("median").alias("median"), r6("scale").alias("scale"))


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS z FROM orders")
def standardized_prices(spark, sf):
    return L.standardize(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", r6("o_totalprice").alias("z"))


@query("SELECT least(floor(o_totalprice / 500000 * 16), 15)::INTEGER AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1")
def histogram_fixed_bins(spark, sf):
    return L.histogram(table(spark, sf, "orders"), "o_totalprice", 16, 0.0, 500000.0)


@query("SELECT vec_id, round(list_avg(list_transform(embedding[1:22], lambda x: x::DOUBLE)), 6) AS a, round(list_avg(list_transform(embedding[23:43], lambda x: x::DOUBLE)), 6) AS b, round(list_avg(list_transform(embedding[44:64], lambda x: x::DOUBLE)), 6) AS c FROM embeddings")
def pooled_profile(spark, sf):
    p = table(spark, sf, "embeddings").select("vec_id", L.pooled(F.col("embedding"), 3).alias("p"))
    return p.select("vec_id", *[r6(F.element_at("p", k + 1)).alias(n) for k, n in enumerate("abc")])


@query()
def kmeans_routing(spark, sf):
    f = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    return L.kmeans(f, k=4)[0].groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def grouped_routing(spark, sf):
    """k-means of the vectors refitted without each label: how many of the label's vectors go to each cluster."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("case_id"), F.col("label").cast("string").alias("label"), F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double")).alias("f"))
    routed, _ = L.grouped_kmeans(e, "label", 4, restarts=2, rounds=8)
    return routed.where("held").groupBy("held_out", "cluster").agg(F.count("*").alias("cases"))


@query()
def ovr_logistic(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("case_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    bank = e.groupBy(F.col("label").alias("proto")).agg(F.count("*").alias("n"))
    folds = L.stratified_folds(e, "label").select("case_id", "fold")
    p = L.out_of_fold(e.select("case_id", "f"), e.select("case_id", F.col("label").alias("proto")), folds, bank)
    return R.auc(p, "p", "y", ["proto"]).withColumn("auc", F.round("auc", 4))


# --- diagnostics ---------------------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT doc_id AS case_id, source FROM documents), l AS (SELECT doc_id AS case_id, 'quality' AS proto FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
 b AS (SELECT DISTINCT proto FROM l), y AS (SELECT c.case_id, c.source, b.proto, CASE WHEN l.case_id IS NULL THEN 0 ELSE 1 END AS y FROM c CROSS JOIN b LEFT JOIN l ON l.case_id = c.case_id AND l.proto = b.proto),
 r AS (SELECT proto, source, avg(y) AS rate FROM y GROUP BY ALL), s AS (SELECT y.proto, y.y, r.rate FROM y JOIN r ON y.proto = r.proto AND y.source IS NOT DISTINCT FROM r.source),
 k AS (SELECT proto, y, rank() OVER (PARTITION BY proto ORDER BY rate) + (count(*) OVER (PARTITION BY proto, rate) - 1) / 2.0 AS k FROM s), a AS (SELECT proto, sum(y) AS p, count(*) - sum(y) AS n, sum(k * y) AS t FROM k GROUP BY proto)
 SELECT a.proto, round((SELECT max(rate) / (sum(rate) + 1e-9) FROM r WHERE r.proto = a.proto), 6) AS largest_share, round((t - p * (p + 1) / 2.0) / (p * n), 6) AS style_auc FROM a WHERE p > 0 AND n > 0"""
)
def group_shares(spark, sf):
    labels = table(spark, sf, "labels")
    stated = labels.select(F.col("doc_id").alias("case_id"), F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic"))))).alias("proto"))
    bank = stated.groupBy("proto").agg(F.count("*").alias("prevalence"))
    s = R.group_shares(stated, table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "source"), bank, "source")
    return s.select("proto", r6("largest_share").alias("largest_share"), r6("style_auc").alias("style_auc"))


@query("WITH j AS (SELECT l.*, d.lang, d.n_chars FROM labels l JOIN documents d USING (doc_id)), h AS (SELECT lang, quality, sum(quality) OVER w AS hits, row_number() OVER w AS spot FROM j WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)), a AS (SELECT lang, sum(CAST(hits AS DOUBLE) / spot * quality) / sum(quality) AS ap FROM h GROUP BY lang HAVING sum(quality) > 0 AND sum(quality) < count(*)) SELECT count(*) AS columns, round(avg(ap), 6) AS mean_average_precision FROM a")
def mean_average_precision(spark, sf):
    return R.mean_average_precision(_labelled(spark, sf), "n_chars", "quality", ["lang"], ["doc_id"]).withColumn("mean_average_precision", r6("mean_average_precision"))


@query("WITH g AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, round(m, 6) AS mean_l_quantity, row_number() OVER (ORDER BY m DESC, l_returnflag, l_linestatus) AS place FROM g ORDER BY place LIMIT 3")
def leaderboard(spark, sf):
    g = R.grid_rollup(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"])
    top = R.leaderboard(g, "mean_l_quantity", ["l_returnflag", "l_linestatus"], 3)
    return top.select("l_returnflag", "l_linestatus", r6("mean_l_quantity").alias("mean_l_quantity"), F.col("place").cast("long").alias("place"))


@query("WITH used AS (SELECT item_id AS proto, bool_or(core) AS core FROM (SELECT item_id, true AS core FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT item_id, false FROM benchmark WHERE item_id % 2 = 0) GROUP BY item_id) SELECT proto, row_number() OVER (ORDER BY proto) - 1 AS compact, core FROM used")
def index_compaction(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("proto"))
    return S.compacted(items.where("proto % 3 = 0"), items.where("proto % 2 = 0")).withColumn("compact", F.col("compact").cast("long"))


@query(f"WITH {Q_SENT}, {Q_PHRASE}, n AS (SELECT doc_id, count(*) AS findings FROM phrase GROUP BY doc_id) SELECT md5(text) AS report, findings FROM n JOIN documents USING (doc_id) WHERE findings >= 2")
def training_pairs(spark, sf):
    p = T.training_pairs(table(spark, sf, "documents"), "text")
    return p.select(F.md5(F.col("report").cast("binary")).alias("report"), F.size("findings").cast("long").alias("findings"))


# --- ranks ---------------------------------------------------------------------------------------------------------------


def _labelled(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


Q_AUC = "j AS (SELECT l.*, d.lang, d.n_chars FROM labels l JOIN documents d USING (doc_id)), k AS (SELECT {0} quality, rank() OVER ({1} ORDER BY n_chars) + (count(*) OVER (PARTITION BY {0} n_chars) - 1) / 2.0 AS r FROM j), a AS (SELECT {0} sum(quality) AS p, count(*) - sum(quality) AS n, sum(r * quality) AS s FROM k {2})"


@query("WITH " + Q_AUC.format("", "", "") + " SELECT p::BIGINT AS positives, n::BIGINT AS negatives, round((s - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM a")
def auc_ties(spark, sf):
    return R.auc(_labelled(spark, sf), "n_chars", "quality").withColumn("auc", r6("auc"))


@query("WITH " + Q_AUC.format("lang,", "PARTITION BY lang", "GROUP BY lang") + ", b AS (SELECT p, (s - p * (p + 1) / 2.0) / nullif(p * n, 0) AS auc, CASE WHEN p BETWEEN 1 AND 60 THEN '1-60' WHEN p >= 61 THEN '61-' END AS band FROM a) SELECT band, count(*) AS columns, round(avg(auc), 6) AS mean_auc, round(sum(auc * p) / sum(p), 6) AS weighted_auc FROM b WHERE auc IS NOT NULL AND band IS NOT NULL GROUP BY band")
def auc_by_support_band(spark, sf):
    s = R.auc_by_support(R.auc(_labelled(spark, sf), "n_chars", "quality", ["lang"]), [(1, 60), (61, None)])
    return s.select("band", "columns", r6("mean_auc").alias("mean_auc"), r6("weighted_auc").alias("weighted_auc"))


@query("WITH j AS (SELECT l.*, d.lang, d.n_chars FROM labels l JOIN documents d USING (doc_id)), h AS (SELECT lang, quality, sum(quality) OVER w AS hits, row_number() OVER w AS spot FROM j WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT lang, round(sum(CAST(hits AS DOUBLE) / spot * quality) / sum(quality), 6) AS average_precision FROM h GROUP BY lang HAVING sum(quality) > 0 AND sum(quality) < count(*)")
def average_precision(spark, sf):
    return R.average_precision(_labelled(spark, sf), "n_chars", "quality", ["lang"], ["doc_id"]).withColumn("average_precision", r6("average_precision"))


@query("SELECT s_suppkey, rank() OVER (ORDER BY s_acctbal DESC) AS s_acctbal_rank, rank() OVER (ORDER BY s_nationkey DESC) AS s_nationkey_rank, round((rank() OVER (ORDER BY s_acctbal DESC) + rank() OVER (ORDER BY s_nationkey DESC)) / 2.0, 6) AS mean_position FROM supplier")
def board_rank_mean(spark, sf):
    b = R.positions(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), ["s_acctbal", "s_nationkey"])
    return b.select("s_suppkey", F.col("s_acctbal_rank").cast("long"), F.col("s_nationkey_rank").cast("long"), r6("mean_position").alias("mean_position"))


@query(
    """WITH b AS (SELECT 'nation ' || s_nationkey AS entry, s_nationkey AS o, round(avg(s_acctbal), 2) AS bleu, count(*)::DOUBLE AS meteor FROM supplier GROUP BY s_nationkey),
 t AS (SELECT c_mktsegment AS entry, 1000 + min(c_custkey) AS o, round(avg(c_acctbal), 2) AS bleu, count(*) / 60.0 AS meteor FROM customer GROUP BY c_mktsegment),
 g AS (SELECT t.entry AS trial, b.* FROM b, t UNION ALL SELECT entry, * FROM t), r AS (SELECT trial, entry, (row_number() OVER (PARTITION BY trial ORDER BY bleu DESC, o) + row_number() OVER (PARTITION BY trial ORDER BY meteor DESC, o)) / 2.0 AS mean_place FROM g)
 SELECT trial, entry, mean_place, mean_place = min(mean_place) OVER (PARTITION BY trial) AS wins FROM r"""
)
def board_insert_simulation(spark, sf):
    """Each segment of customers put by itself on the board of the suppliers' nations."""
    board = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 2).alias("bleu"), F.count("*").cast("double").alias("meteor"))
    board = board.select(F.concat(F.lit("nation "), "s_nationkey").alias("entry"), F.col("s_nationkey").cast("long").alias("input_order"), "bleu", "meteor")
    entries = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("entry")).agg((F.min("c_custkey") + 1000).alias("input_order"), F.round(F.avg("c_acctbal"), 2).alias("bleu"), (F.count("*") / 60.0).alias("meteor"))
    r = R.insert_entry(board, entries, ["bleu", "meteor"])
    return r.select("trial", "entry", "mean_place", "wins")


@query("WITH c AS (SELECT o_orderstatus, o_orderpriority AS n, sum(o_totalprice) AS v FROM orders GROUP BY ALL), s AS (SELECT o_orderstatus, n, sum(v) OVER (PARTITION BY o_orderstatus ORDER BY n) AS v FROM c), g AS (SELECT *, v - coalesce(lag(v) OVER w, 0) AS gain, lag(n) OVER w AS before FROM s WINDOW w AS (PARTITION BY o_orderstatus ORDER BY n)) SELECT o_orderstatus, coalesce((min((n, before)) FILTER (gain < 2.5e7 AND before IS NOT NULL))[2], max(n)) AS knee FROM g GROUP BY o_orderstatus")
def knee_point(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("n")).agg(F.sum("o_totalprice").alias("v"))
    curve = o.withColumn("v", F.sum("v").over(W.partitionBy("o_orderstatus").orderBy("n")))
    return R.knee(curve, "n", "v", 2.5e7, ["o_orderstatus"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS folds, round(avg(l_quantity), 6) AS mean_l_quantity, min(l_quantity) AS worst_l_quantity, round(avg(l_discount), 6) AS mean_l_discount, min(l_discount) AS worst_l_discount FROM lineitem GROUP BY ALL")
def grid_rollup(spark, sf):
    g = R.grid_rollup(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])
    return g.withColumns({c: r6(c) for c in ("mean_l_quantity", "mean_l_discount")})


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def quota_sample(spark, sf):
    return R.quota(table(spark, sf, "documents").select("source", "doc_id"), "source", ["doc_id"], 5)


@query("WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM orders) SELECT round(corr(a, b), 6) AS spearman, (SELECT arg_max(o_totalprice, (o_custkey, o_totalprice)) = max(o_totalprice) FROM orders) AS same_winner FROM r")
def spearman(spark, sf):
    return R.spearman(table(spark, sf, "orders"), "o_totalprice", "o_custkey").withColumn("spearman", r6("spearman"))


# --- searches ------------------------------------------------------------------------------------------------------------


def _benchmark_bank(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Every item as a statement, and as a reference report."""
    items = table(spark, sf, "benchmark")
    return items.select(F.col("item_id").cast("int").alias("proto"), "text", F.col("item_id").cast("int").alias("position")), items.select(F.col("item_id").alias("case_id"), F.col("text").alias("reference"))


@query()
def greedy_report_search(spark, sf):
    bank, refs = _benchmark_bank(spark, sf)
    t = S.greedy(bank, refs, sorted(r["proto"] for r in bank.select("proto").collect()), most=40, refine=2)
    return spark.createDataFrame([(k, s["n"], s["added"], round(s["value"], 6)) for k, s in enumerate(t.steps)], "step int, n int, added int, value double")


#: Flat thresholds, and how many statements a report has at least and at most.
_FLAT, _LEAST, _MOST = [0.5, 0.7, 0.8, 0.9], 1, 4
_Q_GRID = f"""{_Q_STATEMENTS.replace('st AS', 'told AS')}, {D.SQL_BANK}, told_report AS MATERIALIZED (SELECT case_id, string_agg(text, ' ' ORDER BY k) AS report FROM told GROUP BY case_id),
 setting AS (SELECT unnest({_FLAT})::FLOAT AS thr, unnest(range({len(_FLAT)})) AS trial), margins AS (SELECT trial, case_id, proto, p - thr AS margin FROM pr, setting),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY trial, case_id ORDER BY margin DESC, proto) AS rn, sum((margin >= 0)::INT) OVER (PARTITION BY trial, case_id) AS n FROM margins),
 told_pair AS MATERIALIZED (SELECT (trial * 1000000000 + case_id) * 2 AS pair, string_agg(text, ' ' ORDER BY proto) AS prediction, case_id FROM ranked JOIN bank USING (proto) WHERE (margin >= 0 AND rn <= {_MOST}) OR (n < {_LEAST} AND rn <= {_LEAST}) GROUP BY trial, case_id),
 documents AS (SELECT pair AS doc_id, prediction AS text FROM told_pair UNION ALL SELECT pair + 1, report FROM told_pair JOIN told_report USING (case_id))"""
_Q_GRID_ENTAILED = _Q_ENTAILED.replace(_Q_NEXT_TURN, _Q_GRID)
_Q_GRID_PAIRS = _Q_TURN_PAIRS.replace("'x' AS lang", "a.doc_id // 2000000000 AS lang")


@query(
    f"""WITH {_Q_GRID_ENTAILED}, {_q_bleu('lang').replace(Q_PAIRS, _Q_GRID_PAIRS)}, {Q_METEOR}, mm AS (SELECT lang, avg(meteor) AS meteor FROM met2 GROUP BY lang), prs AS (SELECT case_id // 1000000000 AS lang, avg(p) AS p, avg(r) AS r FROM z GROUP BY 1),
 f AS (SELECT lang, cases, bleu_4, meteor, p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS clinical FROM bleu JOIN mm USING (lang) JOIN prs USING (lang))
 SELECT lang AS trial, cases, round(bleu_4, 6) AS bleu_4, round(meteor, 6) AS meteor, round(p, 6) AS logical_precision, round(r, 6) AS logical_recall, round(clinical, 6) AS clinical, round(0.8::DOUBLE * clinical + 0.2::DOUBLE * (bleu_4 + meteor) / 2, 6) AS final FROM f"""
)
def selection_grid(spark, sf):
    """Flat thresholds over all told reports, all in one job, by additive counts."""
    bank = D.bank(spark, sf)
    table = A.with_probabilities(A.case_table(bank, _told_references(spark, sf)), D.probabilities(spark, sf))
    s = A.score_settings(table, A.statements_of(bank), A.Decoding(list(range(30)), _LEAST, _MOST), [dict.fromkeys(range(30), t) for t in _FLAT])
    return s.select("trial", "cases", *[r6(c).alias(c) for c in ("bleu_4", "meteor", "logical_precision", "logical_recall", "clinical", "final")])


def _told_references(spark, sf) -> DataFrame:
    return D.reports(spark, sf).select("case_id", F.array("report").alias("references"))


def _told_foes(bank: DataFrame) -> list[tuple[int, int]]:
    """Conflicting statements of the bank, a short list."""
    s = C.with_mentions(bank.select(F.col("proto").alias("id"), "text"))
    return [(r["i"], r["j"]) for r in X.conflict_pairs(s).collect()]


@query()
def calibrated_thresholds(spark, sf):
    """The ascent over thresholds on the final score of told reports, without conflicts: one threshold for all, then those of the
    twelve commonest statements, which move it most."""
    bank = D.bank(spark, sf)
    table = materialize(A.equal_cases(A.with_probabilities(A.case_table(bank, _told_references(spark, sf)), D.probabilities(spark, sf))), "calibration")
    said, decoding = A.statements_of(bank), A.Decoding(list(range(30)), 2, 6, _told_foes(bank))
    evaluate = lambda settings: [r["final"] for r in A.score_settings(table, said, decoding, settings).orderBy("trial").collect()]
    found, trace = S.calibrate(dict.fromkeys(range(30), 0.5), evaluate, grid=[k / 10 for k in range(1, 10)], local_grid=[0.1, 0.5, 0.9, 2.0], order=list(range(12)))
    return spark.createDataFrame([(p, t, round(trace[-1], 6)) for p, t in sorted(found.items())], "proto int, thr double, final double")


@query()
def constrained_search(spark, sf):
    """The one report of greatest final score over all told reports that neither contradicts nor repeats itself."""
    bank = D.bank(spark, sf)
    keys = C.with_mentions(bank.select("proto", "text")).select("proto", F.to_json(C.assertion_key(F.col("mentions"))).alias("key"))
    rules = S.Rules(_told_foes(bank), {r["proto"]: r["key"] for r in keys.collect()})
    t = S.greedy(bank, _told_references(spark, sf), list(range(30)), most=8, refine=2, clinical=True, objective=S.final, rules=rules)
    return spark.createDataFrame([(k, s["n"], s["added"], round(s["value"], 6)) for k, s in enumerate(t.steps)], "step int, n int, added int, value double")


@query()
def held_out_sweep(spark, sf):
    """One report for all sources but one, for each source and weight, scored on that source; all searches in step."""
    bank = D.bank(spark, sf).where("proto < 12")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.coalesce("source", F.lit("")).alias("source"))
    cases = A.case_table(bank, _told_references(spark, sf).join(docs, "case_id"), keep=["source"], clinical=False)
    groups = sorted(r["source"] for r in docs.select("source").distinct().collect())
    rows = S.held_out_sweep(cases, A.statements_of(bank), list(range(12)), "source", groups, [0.5, 0.2], most=6)
    out = [(r["weight"], r["held_out"], r["n"], ",".join(map(str, r["chosen"])), *(round(r[c], 6) for c in ("train_bleu_4", "train_meteor", "test_bleu_4", "test_meteor"))) for r in rows]
    return spark.createDataFrame(out, "weight double, held_out string, n int, chosen string, train_bleu_4 double, train_meteor double, test_bleu_4 double, test_meteor double")


@query()
def statement_bank(spark, sf):
    """Statement types of the conversations: clusters of phrases that two or more conversations have."""
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("reports"))
    return B.build(c, least_support=2).select("proto", "text", "section", "support", r6("prevalence").alias("prevalence"))
