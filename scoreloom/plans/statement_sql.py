"""SQL for statements, for the twins of queries on mentions, entailment and conflicts.

RE2 looks around nothing: the one pattern with a look-ahead (maxilla, but not the maxillary sinus) is matched on a text
where the sinus is written with other letters of the same number.
"""

from __future__ import annotations

from ..functions import concepts as C
from ..functions import fixed_values as V
from ..functions import text as T


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def ignoring_case(pattern: str) -> str:
    return quoted(f"(?i){pattern}")


def listed(values: list[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def _hits(source: str) -> str:
    """A row for each pattern that a text of `source` (id, text) matches: place of its first match, from 0."""
    found = []
    for order, c in enumerate(C.CONCEPTS):
        for p in c.patterns:
            ahead = r"(?!ry\s+sinus)"
            held = r"regexp_replace(text, '(?i)maxillary(\s+sinus)', 'max_llary\1', 'g')" if ahead in p else "text"
            p = p.replace(ahead, "")
            found.append(
                f"SELECT id, {order} AS ord, {quoted(c.key)} AS concept, {quoted(c.section)} AS section, {quoted(c.flags)} AS flags, len(regexp_extract({held}, {ignoring_case(f'^((?s:.*?))(?:{p})')}, 1)) AS b,"
                f" len(regexp_extract({held}, {ignoring_case(f'^(?s:.*?)(?:{p})')}, 0)) AS e FROM {source} WHERE regexp_matches({held}, {ignoring_case(p)})"
            )
    return " UNION ALL ".join(found)


SIDE = f"CASE WHEN regexp_matches(text, {ignoring_case(V.BILATERAL)}) OR (regexp_matches(text, {ignoring_case(V.LEFT)}) AND regexp_matches(text, {ignoring_case(V.RIGHT)})) THEN 'bilateral' WHEN regexp_matches(text, {ignoring_case(V.LEFT)}) THEN 'left' WHEN regexp_matches(text, {ignoring_case(V.RIGHT)}) THEN 'right' ELSE 'unspecified' END"
_NAMED = rf"regexp_extract_all(array_to_string(regexp_extract_all(text, {quoted(V.TOOTH_NUMBER)}, 1), ' '), '\d{{2}}')"
TEETH = f"list_sort(list_distinct(list_transform(list_filter(CASE WHEN len({_NAMED}) > 0 THEN {_NAMED} ELSE regexp_extract_all(text, {quoted(V.BARE_TOOTH)}, 1) END, lambda n: regexp_matches(n, '^([1-4][1-8]|[5-8][1-5])$')), lambda n: n::INTEGER)))"
_SIZES = f"list_transform(list_zip(regexp_extract_all(text, {ignoring_case(V.MEASUREMENT)}, 1), regexp_extract_all(text, {ignoring_case(V.MEASUREMENT)}, 2)), lambda p: replace(p[1], ',', '.')::DOUBLE * CASE WHEN lower(p[2]) LIKE 'c%' THEN 10.0 ELSE 1.0 END)"


def mentions(source: str) -> str:
    """CTEs up to `mention` (id, ord, concept, section, polarity, laterality, teeth, measurements)."""
    return f"""hits AS ({_hits(source)}), span AS (SELECT id, ord, concept, section, flags, min((e, b)) AS s FROM hits GROUP BY ALL),
 context AS (SELECT id, text, CASE WHEN regexp_matches(text, {ignoring_case(V.NEGATION)}) THEN len(regexp_extract(text, {ignoring_case(f'^((?s:.*?)){V.NEGATION}')}, 1)) ELSE -1 END AS cue, regexp_matches(text, {ignoring_case(V.UNCERTAINTY)}) AS unsure, {SIDE} AS side, {TEETH} AS numbers, {_SIZES} AS sizes FROM {source}),
 mention AS (SELECT id, ord, concept, section, CASE WHEN cue >= 0 AND cue < CASE WHEN contains(flags, 'a') THEN s[2] ELSE s[1] END THEN 'absent' WHEN unsure THEN 'uncertain' ELSE 'present' END AS polarity,
  CASE WHEN contains(flags, 'l') THEN side ELSE 'unspecified' END AS laterality, CASE WHEN contains(flags, 't') THEN numbers ELSE [] END AS teeth, CASE WHEN contains(flags, 'm') THEN sizes ELSE [] END AS measurements FROM span JOIN context USING (id))"""


def signatures(source: str) -> str:
    """CTEs up to `sig` (id, text, n mentions, pairs, keys, side, teeth, words), after those of `mentions`."""
    return f"""{mentions(source)},
 said AS (SELECT id, count(*) AS n, list_sort(list_distinct(list(concept || ':' || polarity))) AS pairs, coalesce(first(laterality ORDER BY ord) FILTER (laterality <> 'unspecified'), 'unspecified') AS side, list_sort(list_distinct(flatten(list(teeth)))) AS teeth FROM mention GROUP BY id),
 sig AS (SELECT s.id, s.text, coalesce(n, 0) AS n, coalesce(pairs, []) AS pairs, list_distinct(list_transform(coalesce(pairs, []), lambda p: split_part(p, ':', 1))) AS keys, coalesce(side, 'unspecified') AS side, coalesce(teeth, []) AS teeth,
  list_filter(list_distinct(list_filter(regexp_extract_all(lower(text), {quoted(T.TOKEN)}), lambda t: regexp_matches(t, '^[\\p{{L}}\\p{{N}}]+$'))), lambda w: NOT list_contains({listed(V.STOPWORDS_ENTAILMENT)}, w)) AS words FROM {source} s LEFT JOIN said USING (id))"""


_CONTRARY = "len(list_filter(list_intersect(a.keys, b.keys), lambda k: (list_contains(a.pairs, k || ':present') AND list_contains(b.pairs, k || ':absent')) OR (list_contains(a.pairs, k || ':absent') AND list_contains(b.pairs, k || ':present')))) > 0"
#: How far b supports a.
ENTAILMENT = f"""CASE WHEN (len(a.keys) > 0 AND len(b.keys) > 0 AND len(list_intersect(a.keys, b.keys)) = 0) OR {_CONTRARY}
 OR (a.side <> 'unspecified' AND b.side <> 'unspecified' AND a.side <> b.side AND NOT (b.side = 'bilateral' AND a.side IN ('left', 'right'))) OR (len(a.teeth) > 0 AND len(b.teeth) > 0 AND len(list_intersect(a.teeth, b.teeth)) = 0) THEN 0.0::DOUBLE
 ELSE least(1.0::DOUBLE, 0.55::DOUBLE * CASE WHEN len(a.keys) > 0 AND len(b.keys) > 0 THEN len(list_intersect(a.keys, b.keys)) / len(a.keys)::DOUBLE WHEN len(a.keys) > 0 OR len(b.keys) > 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END
  + 0.45::DOUBLE * CASE WHEN len(a.words) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.words, b.words)) / len(a.words)::DOUBLE END + CASE WHEN len(list_intersect(a.teeth, b.teeth)) > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) END"""


def _attribute(x: str, group: list[str]) -> str:
    return f"list_sort(list_intersect(list_distinct(regexp_extract_all(lower({x}.text), '[a-z]+')), {listed(group)}))"


def _toothless(x: str, y: str) -> str:
    return f"(regexp_matches({x}.text, {ignoring_case(V.COMPLETE_EDENTULISM)}) AND len({y}.numbers) > 0 AND {y}.claims > 0)"


def conflicts(source: str) -> str:
    """CTEs up to `conflict` (case_id, i, j, reason), within a case, after those of `signatures`. source has case_id too."""
    gone = f"concept IN ({', '.join(quoted(k) for k in V.ABSENCE_CONCEPTS)})"
    exclusive = " OR ".join(f"(len({_attribute('a', g)}) > 0 AND len({_attribute('b', g)}) > 0 AND {_attribute('a', g)} <> {_attribute('b', g)})" for g in V.EXCLUSIVE)
    return f"""{signatures(source)},
 claim AS (SELECT id, count(*) FILTER (NOT {gone}) AS claims, flatten(list(teeth) FILTER (NOT {gone})) AS claimed, flatten(list(teeth) FILTER ({gone})) AS gone FROM mention WHERE polarity = 'present' GROUP BY id),
 fact AS (SELECT sig.*, whose.case_id, numbers, coalesce(claims, 0) AS claims, coalesce(claimed, []) AS claimed, coalesce(gone, []) AS gone FROM sig JOIN context USING (id) JOIN {source} whose USING (id) LEFT JOIN claim USING (id)),
 conflict AS (SELECT * FROM (SELECT a.case_id, a.id AS i, b.id AS j, CASE WHEN {_CONTRARY} THEN 'polarity' WHEN len(list_intersect(a.keys, b.keys)) > 0 AND ({exclusive}) THEN 'exclusive attribute'
  WHEN {_toothless('a', 'b')} OR {_toothless('b', 'a')} THEN 'complete edentulism' WHEN len(list_intersect(a.gone, b.claimed)) > 0 OR len(list_intersect(b.gone, a.claimed)) > 0 THEN 'absent tooth described' END AS reason
  FROM fact a JOIN fact b ON a.case_id = b.case_id AND a.id < b.id) WHERE reason IS NOT NULL)"""
