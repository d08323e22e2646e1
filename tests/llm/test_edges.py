"""Queues, models and rejection against plain Python; clashing columns, repeated rows and empty tables of each operator."""

import math
import random
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scoreloom.llm import base, bm25, jaccard, langid, licenses, lm, maglev, paragraphs, tiff, wfq

#: Names that operators have used for columns of their own.
CLASH = ["s", "g", "k", "c", "w", "_place", "_key", "_letters", "_text", "_spans", "_ends", "_begins", "_mix_words", "_mix_n", "place", "part", "finish", "range", "shard_x", "cls", "token", "turn", "nth", "words", "hash", "uid", "text_hash", "key", "root", "least"]


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(21)
    rows = [(k, prose(rng, 70), "en" if k % 2 else "de", f"s{k % 2}") for k in range(12)]
    rows += [rows[3], (3, "another text of the same key", "en", "s1"), (None, "no key here", None, None), (50, None, "en", "s0"), (51, "", None, "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for n, c in enumerate(CLASH):
        docs = docs.withColumn(c, F.lit(n))
    return docs, rows


def test_clashing_columns_and_repeated_rows(clashing, spark):
    docs, rows = clashing
    shards = {"a": 1, "b": 2}
    assert maglev.assign_shards(docs, shards, slots=251).columns == [*docs.columns, "slot", "shard"]
    assert maglev.assign_shards(docs, shards, slots=251).count() == len(rows) and maglev.assign_shards(docs.where("false"), shards, slots=251).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect())[3] == 2
    model = langid.fit(langid.training_rows(docs))
    assert langid.keep_identified(docs, model).columns == docs.columns
    assert wfq.mixed(docs).columns == docs.columns and wfq.mixed(docs.where("false")).count() == 0
    assert wfq.mix(docs).count() == len(rows)
    items = spark.createDataFrame([(1, rows[2][1][:120])], "item_id long, text string")
    assert bm25.decontaminate(docs, items).columns == docs.columns
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(rows) and licenses.scan_licenses(docs.where("false")).count() == 0
    assert len({str(r) for r in got if r["doc_id"] == 3}) == 2
    wanted = spark.createDataFrame([(1,), (3,)], "doc_id long")
    scores = lm.score(docs, lm.fit(docs, wanted), wanted).collect()
    assert len(scores) == len(rows) and Counter(r["doc_id"] for r in scores)[3] == 3
    assert len({round(r["difference"], 9) for r in scores if r["doc_id"] == 3}) == 2
    assert paragraphs.repeated_paragraphs(docs).count() == 0  # the repeated row is one document
    assert paragraphs.without_repeats(docs, paragraphs.repeated_paragraphs(docs)).columns == docs.columns


def test_repeated_rows_have_one_place(spark):
    rng = random.Random(5)
    line = prose(rng, 60)
    rows = [(1, f"x\n{line}"), (1, f"x\n{line}"), (2, line), (2, f"other text {line} goes on")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.lit(0)).withColumn("_spans", F.lit(1))
    found = paragraphs.repeated_paragraphs(docs)
    got = found.where("n_words >= 60").select("doc_id", "text_hash", "begin", "keep").collect()
    assert len(got) == len(set(got)) and sum(r["doc_id"] == 1 for r in got) == 1
    assert [r["keep"] for r in got if r["doc_id"] == 1] == [True]
    cut = paragraphs.without_repeats(docs, found)
    assert cut.columns == docs.columns
    assert sorted(r["text"] for r in cut.collect())[-2:] == [f"x\n{line}"] * 2 and not any(line in r["text"] for r in cut.where("doc_id = 2").collect())


def test_tiff_of_other_makers(spark):
    files = [(1, tiff.write_tiff(bytes(64), description="A scan of n_bytes=none")), (2, tiff.write_tiff(bytes(64), description="n_bytes=7")), (3, b"")]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files], "key long, media binary")
    got = {r["doc_id"]: r for r in tiff.payload_digests(tiff.tiff_pages(df)).collect()}
    assert got[1]["n_bytes"] is None and got[2]["n_bytes"] == 7 and got[3]["errors"] == 1


def test_results_keep_their_tables(spark, tmp_path):
    """The pipeline deletes its own tables, not those of a result that is still to be read."""
    docs = spark.createDataFrame([(k, f"some words of text number {k % 3} stand here") for k in range(9)], "doc_id long, text string")
    lazy = jaccard.jaccard_components(docs)
    for name, stage in corpus_pipeline.STAGES[1:2] * 2:
        assert stage(spark, docs, "").count() == 3
    assert lazy.count() == 9
    with base.owned() as written:
        base.materialize(docs, "x")
    assert len(written) == 1
    base.drop(spark, written)
    assert not written


def test_no_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        base.shared_dir(Session())


# --- op2 ---------------------------------------------------------------------------------------------------------------


def test_queue_is_cut_at_the_budget(spark):
    """The rows served are those that come first by finish until the budget is spent, as plain Python counts it."""
    rng = random.Random(11)
    rows = [(k, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(300)] + [(7, "w w", "b"), (7, "w w", "b"), (None, "w", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    queue = wfq.fair_queue(docs)
    got = queue.collect()
    targets = {r["source"]: r["target"] for r in got}
    # each document and epoch once, or in two rows about its source's target
    for own in _by([r for r in got if r["size"]], "source", "place", "epoch").values():
        assert len(own) <= 2
    budget = sum(math.floor(t + 1e-6) for t in targets.values())
    assert sum(r["part"] for r in got) == budget
    served = [r for r in got if r["part"]]
    rest = [r for r in got if not r["part"] and r["size"]]
    assert max(r["finish"] for r in served) <= 1 < min(r["finish"] for r in rest)
    for source, target in targets.items():
        assert sum(r["part"] for r in served if r["source"] == source) == math.floor(target + 1e-6)
    plan = queue._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Window" in plan.split("RepartitionByExpression")[0] and "PythonUDF" not in plan


def _by(rows, *columns):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[c] for c in columns)].append(r)
    return out


# --- op3 ---------------------------------------------------------------------------------------------------------------


def test_language_matches_plain_vectors(spark):
    """Predictions and scores are those of TF-IDF vectors and cosines in plain Python, given the fitted centroids."""
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.randint(3, 60), "abcdefg" if k % 2 else "defnopq"), "xx" if k % 2 else "yy") for k in range(120)] + [(200, prose(rng, 9000), "xx"), (300, "abc", "xx"), (300, "abc", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("turn", F.lit(1)).withColumn("letters", F.lit(1))
    training = [r for r in rows if not langid_held(r[0])]
    model = langid.fit(langid.training_rows(docs))
    df = Counter()
    for _, t, _ in training:
        df.update(set(places(t)))
    n = len(training)
    idf = {p: math.log((1 + n) / (1 + c)) + 0.05 for p, c in df.items()}
    other = math.log(1 + n) + 0.05
    for r in langid.identify(docs, model).collect():
        for text in {t for k, t, _ in rows if k == r["doc_id"]}:
            counts = Counter(places(text))
            v = {p: (1 + math.log(c)) * idf.get(p, other) for p, c in counts.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            near = [sum(x * float(c[p]) for p, x in v.items()) / norm for c in model.centroids]
            assert r["score"] == pytest.approx(max(near), abs=1e-4) and r["lang_pred"] == model.languages[int(np.argmax(near))]


def langid_held(key):
    import zlib

    return zlib.crc32(str(key).encode()) % 4 == 2


def places(text):
    raw = f" {text.lower()} ".encode()
    m = (1 << 32) - 1
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        yield ((((a * 2654435761 & m) ^ (b * 2246822519 & m) ^ (c * 3266489917 & m)) * 2654435761) & m) >> 20


def test_rejection_acts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    rng = random.Random(3)
    junk = ["漢字" * 60, "".join(rng.choice("0123456789abcdef") for _ in range(600)), " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(120)), "Это русский текст и больше ничего " * 4]
    assert model.predict(junk)[2].all()
    got = langid.identify(docs, model)
    assert got.where("not rejected").count() >= 0.985 * got.count()


# --- op6 ---------------------------------------------------------------------------------------------------------------


def test_scores_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k if k else None, prose(rng, rng.randint(8, 60))) for k in range(30)]
    docs = spark.createDataFrame([(k, f"{prose(rng, 100)} {items[k][1]} {prose(rng, 50)}") for k in range(30)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r["doc_id"], r["item_id"] or -1, round(r["score"], 9))
    one = sorted(map(key, bm25.leaks(docs, b).collect()))
    monkeypatch.setattr(bm25, "INDEX_CHARS", 900)
    assert len(list(bm25.indexes(b))) > 2
    assert sorted(map(key, bm25.leaks(docs, b).collect())) == one and len({(d, i) for d, i, _ in one}) >= 30


def test_passages_go_by_an_items_own_length(spark, monkeypatch):
    """Items of 5 to 2,000 words: the same leaks however the items are split over indexes, and each is found alone or not."""
    rng = random.Random(31)
    items = [(k, prose(rng, n, string.ascii_lowercase)) for k, n in enumerate([5, 6, 40, 60, 63, 64, 65, 66, 120, 300, 900, 2000])]
    apart = items[3][1].split()
    docs = [(100 + k, prose(rng, 150, string.ascii_lowercase) + " " + t + " " + prose(rng, 700, string.ascii_lowercase)) for k, t in items]
    docs += [(200, " ".join(apart[:30]) + " " + prose(rng, 250, string.ascii_lowercase) + " " + " ".join(apart[30:])), (201, prose(rng, 3000, string.ascii_lowercase)), (202, None), (203, "x " * 200_000)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r["doc_id"], r["item_id"], round(r["score"], 9), r["passage"])
    whole = sorted(map(key, bm25.leaks(d, b).collect()))
    assert {(100 + k, k) for k, _ in items} <= {(x, i) for x, i, _, _ in whole} and not {200, 201, 202, 203} & {x for x, _, _, _ in whole}
    for chars in (1, 700, 9000):
        monkeypatch.setattr(bm25, "INDEX_CHARS", chars)
        assert len(list(bm25.indexes(b))) > 1 and sorted(map(key, bm25.leaks(d, b).collect())) == whole


def test_queue_ranges_stay_narrow(spark, monkeypatch):
    """23 sources, one of weight 1 with nearly half of all documents, one without a word: no range holds many times the mean."""
    monkeypatch.setattr(wfq, "RANGE_ROWS", 64)
    rows = [(k, f"s{k % 22:02d}" if k % 7 else "s02", "some words of a text") for k in range(6000)] + [(10_000 + k, "s02", "five words are in here") for k in range(5000)]
    rows += [(20_000 + k, "empty", None if k % 2 else " ") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    queue = wfq.fair_queue(docs).collect()
    early = [r for r in queue if r["finish"] <= 1 and r["size"]]
    ranges = -(-len(early) // 64)
    assert max(Counter(math.floor(r["finish"] * ranges) for r in early).values()) <= 3 * 64
    assert {r["doc_id"] for r in queue} == {r[0] for r in rows} and all(r["part"] == 0 for r in queue if r["finish"] > 1)
    taken, target, size = Counter(), {}, Counter()
    for r in queue:
        taken[r["source"]] += r["part"]
        target[r["source"]] = r["target"]
        size[r["source"]] = r["source_size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and taken["empty"] == 0
    assert sum(taken.values()) == pytest.approx(sum(size.values()), abs=len(target))
