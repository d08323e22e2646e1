"""Each operator against brute force or an exact round trip, on small tables with nulls, empty and long texts, ties,
repeated rows, no rows, and further columns of clashing names."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import base, bm25, families, jaccard, langid, licenses, lm, maglev, paragraphs, queries, rans, shingles, tiff, wfq

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, cls long, token string, place long"


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base_text = prose(rng, 120)
    out = [(k, prose(rng, rng.randint(6, 200)), "en", f"s{k % 3}") for k in range(30)]
    for k in range(30, 60):  # near copies: a few words changed
        words = base_text.split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out.append((k, " ".join(words), "en", "s0"))
    out += [(60, None, None, None), (61, "", "en", "s1"), (62, " \t\n", "en", None), (63, "one two", "en", "s2"), (64, "ONE two", "en", "s2"), (65, "x" * 5000, "en", "s1"), (66, prose(rng, 8000), "en", "s1"), (None, "no key at all here", "en", "s1"), (67, "12 34 !!", "en", "s2"), (31, out[31][1], "en", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 9, 9, "t", 9) for r in rows], DOCS)


def words_of(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\x09\x0a\x0b\x0c\x0d" else c for c in text or "").split(" ") if w]


def shingle_set(text):
    w = words_of(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


# --- op1 ---------------------------------------------------------------------------------------------------------------


def test_tiff_payloads(docs, rows, spark):
    import hashlib

    got = defaultdict(list)
    for r in tiff.payload_digests(tiff.tiff_pages(tiff.texts_to_tiff(docs))).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for key, text, *_ in rows:
        raw = (text or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[key][0]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r["errors"] == 0
    assert tiff.payload_digests(tiff.tiff_pages(tiff.texts_to_tiff(docs.where("false")))).count() == 0


def test_tiff_codecs_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 254, 255, 256, 257, 3829, 3830, 3831, 30000):
        for data in (rng.randbytes(n), b"ab" * (n // 2), b"\0" * n):
            assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
            assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    raw = rng.randbytes(64 * 1300)
    for order in "<>":
        for turn in range(len(tiff.PLAN)):
            pages = list(tiff.read_pages(tiff.write_tiff(raw, turn=turn, order=order)))
            assert b"".join(p.pixels for p in pages) == raw and len(pages) == 3


def test_tiff_predictors():
    a = np.arange(2 * 5 * 3, dtype="<u2").reshape(2, 5, 3) * 7
    d = a.copy()
    d[:, 1:] -= a[:, :-1]
    assert (tiff._unpredict(d, 2, "<") == a).all()
    f = np.linspace(-3, 9, 24, dtype="<f4").reshape(2, 12, 1)
    planes = np.ascontiguousarray(f.astype(">f4")).view(np.uint8).reshape(2, 12, 4).transpose(0, 2, 1).reshape(2, 48)
    diff = planes.copy()
    diff[:, 1:] = planes[:, 1:] - planes[:, :-1]
    assert (tiff._unpredict(diff.reshape(2, 48).view("<f4").reshape(2, 12, 1), 3, "<") == f).all()


def test_tiff_broken_files(spark):
    good = tiff.write_tiff(bytes(64 * 40))
    (at,) = struct.unpack_from("<I", good, 4)
    (n,) = struct.unpack_from("<H", good, at)
    circle = good[: at + 2 + 12 * n] + struct.pack("<I", at)
    assert [p.error is None for p in tiff.read_pages(circle)] == [True, False]
    files = spark.createDataFrame([(0, None), (1, b""), (2, b"II*\0"), (3, good[: len(good) // 2]), (4, bytearray(good)), (5, bytearray(circle))], "key long, media binary")
    got = {(r["key"], r["page"]): r["error"] for r in tiff.tiff_pages(files).collect()}
    assert all(got[(k, 0)] for k in range(4)) and got[(4, 0)] is None and got[(5, 1)]


# --- op2 ---------------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left, share = total - sum(capped.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / share > 3 * sizes[s]]
        if not over:
            return capped | {s: left * w[s] / share for s in rest}
        capped |= {s: 3 * sizes[s] for s in over}


def test_mix(docs, rows):
    got = wfq.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words_of(t))
    want, taken = plain_targets(dict(sizes)), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 1
    again = wfq.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert wfq.mix(docs.where("false")).count() == 0


def test_mix_caps_small_sources(spark):
    d = spark.createDataFrame([(k, "w " * 1000, "b") for k in range(20)] + [(100, "one two three", "a"), (101, "x", "c")], "doc_id long, text string, source string")
    got = wfq.mix(d).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
    by = {r["source"]: r for r in got}
    assert by["a"]["n"] == 9 and by["c"]["n"] == 3 and abs(by["b"]["n"] - by["b"]["t"]) <= 1


def test_mixed_documents(docs):
    out = wfq.mixed(docs)
    assert out.columns == docs.columns
    served = wfq.mix(docs).agg(F.sum("taken")).first()[0]
    assert out.select(F.sum(wfq.word_count(F.col("text")))).first()[0] == served


# --- op3 ---------------------------------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, 60, "abcdefg" if k % 2 else "nopqrst"), "xx" if k % 2 else "yy") for k in range(160)]
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "12 34", "yy"), (903, "漢字漢字漢字漢字漢字漢字 漢字漢字", None), (None, "abc abd", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(langid.training_rows(docs))).collect()}
    assert len(got) == len(rows)
    for k, t, lang in rows[:160]:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and got[k]["lang_pred"] == lang and 0 <= got[k]["score"] <= 1 and not got[k]["rejected"]
    assert all(got[k]["lang_pred"] == "und" and got[k]["rejected"] for k in (900, 901, 902)) and got[903]["rejected"]
    kept = langid.keep_identified(docs, langid.fit(langid.training_rows(docs)))
    assert kept.columns == docs.columns and kept.count() == 161
    empty = docs.where("false")
    assert langid.fit(langid.training_rows(empty)) is None and langid.identify(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


# --- op4 ---------------------------------------------------------------------------------------------------------------


def test_cross_entropy(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, 80, "abc" if k % 4 == 0 else "xyz")) for k in range(80)] + [(500, None), (501, ""), (None, "a b"), (502, "q" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = spark.createDataFrame([(k,) for k in range(0, 40, 4)], "doc_id long")
    models = lm.fit(docs, wanted)
    got = {r["doc_id"]: r for r in lm.score(docs, models, wanted).collect()}
    assert len(got) == len(rows) and got[500]["n_words"] == got[501]["n_words"] == 0 and got[500]["difference"] == 0
    assert got[0]["in_target"] and not got[44]["in_target"]
    assert max(got[k]["difference"] for k in range(0, 80, 4)) < min(got[k]["difference"] for k in range(1, 80) if k % 4)
    # the counts are those of plain counting
    counts = Counter(w for _, t in rows for w in (t or "").lower().split())
    for w, k in list(models.number.items())[:50]:
        assert models.unigram[1, k] == counts[w]
    assert models.pairs[1].sum() == sum(counts.values())
    assert lm.score(docs.where("false"), models, wanted).count() == 0


def plain_losses(rows, wanted):
    """Exact counts of all words and pairs, in plain Python."""
    texts = [(k, (t or "").lower().split()) for k, t in rows]
    outcomes = len({w for _, t in texts for w in t}) + 1
    models = []
    for of in (lambda k: k in wanted, lambda k: True):
        words, pairs, firsts = Counter(), Counter(), Counter()
        for k, t in texts:
            if of(k):
                words.update(t)
                pairs.update(zip(["<s>", *t], t))
                firsts.update(["<s>", *t][: len(t)])
        models.append((words, pairs, firsts))
    out = {}
    for k, t in texts:
        got = []
        for (words, pairs, firsts), less in zip(models, (k in wanted, True)):
            own, own_pairs, own_firsts = Counter(t), Counter(zip(["<s>", *t], t)), Counter(["<s>", *t][: len(t)])
            loss = 0.0
            for a, b in zip(["<s>", *t], t):
                p1 = (words[b] - less * own[b] + 1) / (sum(words.values()) - less * len(t) + outcomes)
                loss -= np.log((pairs[a, b] - less * own_pairs[a, b] + lm.PRIOR * p1) / (firsts[a] - less * own_firsts[a] + lm.PRIOR))
            got.append(loss / max(len(t), 1))
        out[k] = (k in wanted, len(t), *got)
    return out


def test_cross_entropy_is_exact(spark, monkeypatch):
    """Each word and pair has its own count however many there are, over several chunks and ranges of keys."""
    monkeypatch.setattr(lm, "CHUNK_WORDS", 3000)
    monkeypatch.setattr(lm, "RANGE_WORDS", 20_000)
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{int(rng.expovariate(1) * 40_000)}" for _ in range(600))) for k in range(150)] + [(200, None), (201, "É é a"), (202, " ")]
    wanted_keys = set(range(0, 150, 3)) | {201}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = spark.createDataFrame([(k,) for k in sorted(wanted_keys)] * 2, "doc_id long")
    models = lm.fit(docs, wanted)
    want = plain_losses(rows, wanted_keys)
    # the second table is no longer that of fit: its chunks only ask
    for asked in (docs, docs.where("doc_id < 90")):
        got = lm.score(asked, models, wanted).collect()
        assert len(got) == asked.count()
        for r in got:
            inside, n, target, background = want[r["doc_id"]]
            assert (r["in_target"], r["n_words"]) == (inside, n)
            assert abs(r["loss_target"] - target) < 1e-9 and abs(r["loss_background"] - background) < 1e-9


# --- op5 ---------------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    rows = [
        (0, "Licensed under CC BY-NC 4.0; cc by cc by"), (1, None), (2, ""), (3, "All  Rights\nReserved."), (4, "general public licenses"),
        (5, "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-or-later WITH Classpath-exception-2.0\nx"), (6, "word " * 20000 + "GENERAL public license"), (None, "ccé by cc by"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    import re

    for key, text in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [k for p in licenses.BASE_PHRASES for q in [p.split()] for k in range(len(w)) if w[k : k + len(q)] == q]
        r = got[key]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
    assert got[0]["labels"] == "cc-by,cc-by-nc" and got[3]["base_labels"] == "reserved" and got[1]["labels"] == "" and got[1]["score"] == 0
    assert got[5]["labels"] == "apache-2.0,gpl,mit" and got[5]["score"] == 1 and got[5]["binding"] == 1


def test_expressions():
    value = lambda t: licenses.parse_expression(t)[0]
    assert value("MIT OR GPL-2.0-only").binding == 0 and value("MIT AND GPL-2.0-only").binding == 2
    assert value("MIT OR GPL-2.0 AND CC-BY-NC-4.0").binding == 0 and value("(MIT OR GPL-2.0) AND CC-BY-NC-4.0").binding == 3
    assert value("AND MIT") is None and value("") is None and value("((MIT)") is None and value("MIT AND").labels == {"mit"}


# --- op6 ---------------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(8, 90))) for k in range(40)] + [(90, None), (91, ""), (92, "two words")]
    docs, want = [], set()
    for k in range(60):
        t = prose(rng, 300)
        if k % 3 == 0:
            i, x = items[k % 40]
            cut = rng.randrange(0, 900)
            t = f"{t[:cut]} {x}, {t[cut:]}"
            want.add((k, i))
        docs.append((k, t))
    docs += [(100, None), (101, ""), (None, items[3][1]), (0, docs[0][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = bm25.leaks(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(None, 3)}
    assert sum(r["doc_id"] == 0 for r in got) == 2
    left = bm25.decontaminate(d, b)
    assert left.columns == d.columns and left.count() == len(docs) - len(want) - 2
    assert bm25.leaks(d, b.where("false")).count() == 0 and bm25.leaks(d.where("false"), b).count() == 0


def test_wand_is_exact():
    rng = random.Random(5)
    index = bm25.BlockMaxIndex([(k, prose(rng, rng.randint(5, 60), "abcd")) for k in range(120)])
    pool = [w for x in index.words for w in x]
    for k in range(200):
        index.threshold = rng.choice([0.05, 0.1, 0.2, 0.4, 0.6])
        q = rng.sample(pool, rng.choice([3, 20, 60])) + (rng.choice(index.words) if k % 2 else [])
        sums = Counter()
        for t in set(q):
            for d, v in zip(index.items.get(t, []), index.impacts.get(t, [])):
                sums[d] += v
        assert sorted(d for d, _ in index.query(q)) == sorted(d for d, v in sums.items() if v >= index.threshold - 1e-9)


# --- op7 ---------------------------------------------------------------------------------------------------------------


def test_rans_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 16384, 16385, 70000):
        ids = np.minimum(rng.zipf(1.3, n), 50000).astype(np.uint32)
        data = rans.encode([7, None], ids, np.array([n, 0]))
        names, back, lengths = rans.decode(data)
        assert names == [7, None] and (back == ids).all() and lengths.tolist() == [n, 0]
        if n > 16384:
            assert (rans.decode_block(data, 1) == ids[16384:32768]).all() and (rans.decode_block(data, 0, 2) == ids[2 * 512 * 8 : 16384]).all()
        for at in (5, len(data) // 2):
            with pytest.raises(rans.CorruptFile):
                rans.decode(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_pieces_match_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    texts = ["", " ", "a  b", "a   b", " \nx", "x \n y", "x\n\n y  ", "\n \ny", "!! ! ", " a", "\ta \t b", "it's  don't 's", "a <|endoftext|> b", "日本 語 ê", "a b 　 c", "word, word. Word's 3x 44", "x\n ", prose(random.Random(1), 500)]
    for t, got in zip(texts, rans.encode_texts(texts, path)):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_token_files(docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    files = rans.write_token_files(docs, queries.tokenizer_path(), segment_ids=3000)
    got = sorted(rans.token_index(files).collect(), key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (key, text, *_) in zip(got, order, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert rans.token_index(rans.write_token_files(docs.where("false"), queries.tokenizer_path())).count() == 0


# --- op8 ---------------------------------------------------------------------------------------------------------------


def plain_components(rows, per_cent=75):
    sets = [shingle_set(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                up[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return [(r[0], len(sets[k]), least.get(root(k)), links[k]) for k, r in enumerate(rows)]


@pytest.mark.parametrize("family_tokens", [None, 700])
def test_components(docs, rows, family_tokens):
    got = [tuple(r) for r in jaccard.jaccard_components(docs, family_tokens=family_tokens).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(plain_components(rows), key=key)
    assert jaccard.jaccard_components(docs.where("false")).count() == 0


def test_one_of_each(docs, rows):
    kept = jaccard.one_of_each(docs)
    want = {c for _, _, c, _ in plain_components(rows) if c is not None}
    got = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1


def test_verify_both_ways():
    rng = random.Random(6)
    pool = [rng.getrandbits(64) for _ in range(90)]
    sets = []
    for _ in range(120):
        s = set(pool)
        for _ in range(rng.choice([0, 3, 8, 15, 40])):
            s.discard(rng.choice(pool))
            s.add(rng.getrandbits(64))
        sets.append(np.unique(np.array(list(s), np.uint64)))
    plain = [set(s.tolist()) for s in sets]
    want = {(i, j) for i in range(120) for j in range(i) if 100 * len(plain[i] & plain[j]) >= 75 * len(plain[i] | plain[j])}
    for dense in (families.DENSE, 0):
        assert {(d, x) for d, found in families.verify(sets, None, 75, dense) for x in found.tolist()} == want


def test_connected_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 180), rng.randrange(100, 180)) for _ in range(50)] + [(7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in base.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert base.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op9 ---------------------------------------------------------------------------------------------------------------


def test_lookup_table():
    shards = {"a": 1, "b": 2, "c": 1}
    table = maglev.lookup_table(shards, 251)
    counts = Counter(table)
    assert sum(counts.values()) == 251 and abs(counts["b"] - 2 * counts["a"]) <= 2
    moved = sum(x != y for x, y in zip(table, maglev.lookup_table({**shards, "d": 1}, 251)))
    assert moved < 251 * 0.45
    for bad in ({}, {"a": 0}):
        with pytest.raises(ValueError):
            maglev.lookup_table(bad, 251)
    with pytest.raises(ValueError):
        maglev.lookup_table(shards, 250)


def test_assign_shards(docs, rows):
    import hashlib

    shards = {f"s{k}": 1 for k in range(5)}
    table = maglev.lookup_table(shards, 251)
    got = maglev.assign_shards(docs.withColumn("slot", F.lit(1)), shards, slots=251)
    assert got.count() == len(rows) and "PythonUDF" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == table[int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 251]


# --- op10 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("family_tokens", [None, 600])
def test_paragraphs(spark, family_tokens):
    rng = random.Random(9)
    passages = [prose(rng, rng.randint(52, 80)) for _ in range(8)]
    rows = []
    for k in range(50):
        lines = [prose(rng, rng.randint(5, 90)) for _ in range(3)]
        if k % 2:
            w = passages[k % 8].split()
            if k % 3 == 0:
                w[3] = "changed"
            lines.insert(rng.randrange(4), " ".join(w))
        rows.append((k, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, passages[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    places = [(k, b, e, line) for k, t in rows for b, e, line in paragraphs.paragraphs_of(t or "")]
    comp = plain_components([(n, p[3]) for n, p in enumerate(places)])
    sizes = Counter(c for _, _, c, _ in comp)
    want = {(p[0], p[1], p[2], sizes[c[2]]) for p, c in zip(places, comp) if sizes[c[2]] > 1}
    got = paragraphs.repeated_paragraphs(docs, family_tokens=family_tokens)
    found = got.collect()
    assert {(r["doc_id"], r["begin"], r["end"], r["places"]) for r in found} == want
    assert sum(r["keep"] for r in found) == len({r["cluster"] for r in found})
    cut = {r["doc_id"]: r["text"] for r in paragraphs.without_repeats(docs, got).collect()}
    assert len(cut) == len(rows) and cut[100] is None and cut[0] == rows[0][1]
    gone = {r["doc_id"]: r for r in found if not r["keep"] and r["doc_id"] is not None}
    for k, r in list(gone.items())[:5]:
        assert rows[k][1][r["begin"] : r["end"]] not in cut[k]
    assert paragraphs.repeated_paragraphs(docs.where("false")).count() == 0


def test_passages_inside_lines(spark):
    """A passage of 55 words is found where it begins mid-line, spans a line break or lies in a longer line, to the word."""
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(55)
    w = passage.split()
    broken = " ".join(w[:20]) + "\n" + " ".join(w[20:])
    rows = [(1, words(100) + " " + passage + " " + words(90)), (2, words(7) + "\né " + broken + " " + words(30)), (3, words(30) + "\n" + words(30) + " " + passage.upper()), (4, words(300)), (5, words(40) + " " + " ".join(w[:40]) + " " + words(40)), (6, None), (7, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeated_paragraphs(docs)
    got = {r["doc_id"]: r for r in found.collect()}
    text = dict(rows)
    assert {1, 2, 3, 7} <= set(got) and not {4, 6} & set(got)
    for k in (1, 2, 3, 7):
        assert text[k][got[k]["begin"] : got[k]["end"]].lower().split() == w and got[k]["n_words"] == 55
    assert [got[k]["keep"] for k in (1, 2, 3, 7)] == [True, False, False, False]
    cut = {r["doc_id"]: r["text"] for r in paragraphs.without_repeats(docs, found).collect()}
    assert w[30] in cut[1] and w[30] not in cut[2] and cut[4] == text[4]


def test_shingles_match_plain():
    rng = random.Random(10)
    texts = ["", " ", "a", "A b", "a b c d e", "a b c d e a b c d e", "É x y z q w e", "\x0b\x0ca\x0db", prose(rng, 3000), "w" * 400 + " b c d e f"]
    for t, (n, h) in zip(texts, shingles.shingle_sets([t.encode() for t in texts])):
        assert n == len(words_of(t)) and len(h) == len(shingle_set(t))
