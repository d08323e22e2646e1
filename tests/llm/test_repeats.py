"""Repeated paragraphs: one place of every passage stays, and passages against a search over all runs of words."""

import random
from collections import defaultdict

import pytest

from scoreloom.llm import paragraphs


def words(rng, n):
    return [f"w{rng.randrange(10**7):x}" for _ in range(n)]


def folded(text):
    return text.lower().encode().split() if text else []


def stands_in(run, texts):
    run = b" " + b" ".join(run) + b" "
    return any(run in b" " + b" ".join(t) + b" " for t in texts)


def remains(spark, rows, found):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = paragraphs.without_repeats(docs, found).collect()
    assert len(left) == len(rows)
    return left


def check_survivors(rows, found, left):
    """Each cluster has one kept row at most; what a row shows stands whole in what is left, but for near copies of kept lines."""
    text = dict(rows)
    folds = [folded(r["text"]) for r in left]
    clusters = defaultdict(list)
    for r in found:
        clusters[r["cluster"]].append(r)
    lost = []
    for own in clusters.values():
        assert sum(r["keep"] for r in own) <= 1 and {r["places"] for r in own} == {len(own)}
        for r in own:
            run = folded(text[r["doc_id"]][r["begin"] : r["end"]])
            if not stands_in(run, folds):
                lost.append((r["doc_id"], r["begin"]))
    return lost


def test_a_passage_in_a_removed_line_stays_elsewhere(spark):
    rng = random.Random(1)
    line, new = words(rng, 1000), words(rng, 70)
    rows = [(1, " ".join(line)), (2, " ".join(line[:500] + new + line[500:])), (3, " ".join(words(rng, 40) + new + words(rng, 40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeated_paragraphs(docs)
    got = found.collect()
    by = {(r["doc_id"], r["keep"]) for r in got}
    assert {(1, True), (2, False), (3, True)} <= by and (3, False) not in by
    left = {r["doc_id"]: r["text"] for r in remains(spark, rows, found)}
    assert " ".join(new) in left[3] and " ".join(line) in left[1] and not left[2].strip()


def test_the_place_in_a_kept_line_stays(spark):
    """A passage that an earlier document has amid other text goes there, as a kept line holds it too."""
    rng = random.Random(2)
    line = words(rng, 400)
    rows = [(1, " ".join(words(rng, 30) + line[100:180] + words(rng, 30))), (2, " ".join(line)), (3, " ".join(line))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeated_paragraphs(docs)
    assert {(r["doc_id"], r["keep"], r["places"]) for r in found.collect()} == {(1, False, 1), (2, True, 2), (3, False, 2)}
    left = {r["doc_id"]: folded(r["text"]) for r in remains(spark, rows, found)}
    assert left[2] == [w.encode() for w in line] and left[3] == [] and len(left[1]) == 60


def repeated_words(rows, least):
    """Of each document the words that lie in a run of so many words that stands in another place too."""
    places = defaultdict(list)
    for k, text in rows:
        w = folded(text)
        for i in range(len(w) - least + 1):
            places[tuple(w[i : i + least])].append((k, i))
    out = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                out[k].update(range(i, i + least))
    return out


def spots(text):
    """Begin and end of each word, in characters."""
    out, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_passages_against_all_runs(spark, seed):
    rng = random.Random(seed)
    pool = [words(rng, rng.choice([30, 49, 50, 55, 80, 140])) for _ in range(9)]
    rows = []
    for k in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.choice([0, 0, 0, rng.randrange(len(p) // 3)])
            parts.append(rng.choice([p, p[a:], words(rng, rng.randint(5, 60))]))
        flat = [w for p in parts for w in [*p, *words(rng, rng.randint(0, 9))]]
        rows.append((k, "".join(w + rng.choice([" "] * 12 + ["\n", "  "]) for w in flat)))
    rows += [(90, None), (91, ""), (92, " ".join(words(rng, 60_000) + pool[3]))]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string")
    found = paragraphs.repeated_passages(docs).collect()
    text = dict(rows)
    runs, windows = repeated_words(rows, 50), repeated_words(rows, 25)
    covered = defaultdict(set)
    for r in found:
        covered[r["doc_id"]].update(i for i, (a, b) in enumerate(spots(text[r["doc_id"]])) if r["begin"] <= a and b <= r["end"])
    for k, _ in rows:
        assert runs[k] <= covered[k] <= windows[k]
    everything = paragraphs.repeated_paragraphs(docs)
    got = everything.collect()
    assert not check_survivors(rows, got, remains(spark, rows, everything))


def test_survivors_amid_near_copies_of_lines(spark):
    """Lines and passages mixed: what is kept stands whole, and what goes with a removed line is in no kept place's words."""
    rng = random.Random(9)
    base, extra = [words(rng, rng.choice([90, 300])) for _ in range(6)], [words(rng, 60) for _ in range(4)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(rng.randint(1, 3)):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice([*extra, words(rng, 3)]) + line[at:]
            lines.append(" ".join(line))
        rows.append((k, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeated_paragraphs(docs)
    got, left = found.collect(), remains(spark, rows, found)
    lost = set(check_survivors(rows, got, left))
    assert not {(r["doc_id"], r["begin"]) for r in got if r["keep"]} & lost
    lines = {(r["doc_id"], r["begin"]) for r in paragraphs.repeated_lines(docs).collect()}
    assert lost <= lines  # a near copy of a kept line goes with its own words; a passage never does
    folds = [folded(r["text"]) for r in left]
    assert sum(stands_in([w.encode() for w in x], folds) for x in extra) >= 3
