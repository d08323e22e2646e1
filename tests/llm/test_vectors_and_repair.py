"""Product codes, exact top products and conversation repair against plain Python, with ties, nulls and empty tables."""

import hashlib
import heapq
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import inner, repair, vectors, vq

SCHEMA = "vec_id long, embedding array<float>, label int"


def as_ints(v):
    return [math.floor(float(np.float32(x)) * 256) for x in v]


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def hard_vectors(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(16)], rng.choice([0, 1, 2, None])) for k in range(260)]
    rows += [(k, rows[7][1], 1) for k in range(300, 460)]  # a third alike
    rows += [rows[50], rows[50], (None, [0.5] * 16, 2), (600, None, 1), (650, [None] + [0.1] * 15, 1), (700, [float("nan")] * 16, 0), (750, [float("inf")] * 16, 0)]
    rows += [(800, [0.25] * 10, 3), (850, [], 3), (900, [-3.0] * 16, None), (950, [200.0] * 16, 5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("row", "block", "ints", "square", "code", "error", "l", "part", "entry", "lot", "g", "b", "q")})
    return rows, df


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, as_ints(v), lab) for i, v, lab in rows if whole(v)]
    dim = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = [(i, v + [0] * (dim - len(v)), lab) for i, v, lab in kept]
    m = dim // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * m : (p + 1) * m] for r in first] for p in range(parts)]

    def nearest(v, p):
        x = v[p * m : (p + 1) * m]
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        got = defaultdict(list)
        for _i, v, _l in kept:
            for p in range(parts):
                got[p, nearest(v, p)[1]].append(v[p * m : (p + 1) * m])
        for (p, k), xs in got.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    coded = [(i, lab, [nearest(v, p) for p in range(parts)]) for i, v, lab in kept]
    total = defaultdict(int)
    for _i, lab, at in coded:
        total[lab] += sum(d for d, _ in at)
    return sorted(((i, "".join(f"{k:02x}" for _, k in at), sum(d for d, _ in at), total[lab], digest) for i, lab, at in coded), key=repr)


@pytest.mark.parametrize("entries", [1, 12])
def test_product_codes_against_plain_python(hard_vectors, entries):
    rows, df = hard_vectors
    got = sorted((tuple(r) for r in vq.encode(df, parts=4, entries=entries).collect()), key=repr)
    assert got == plain_codes(rows, 4, entries, 2)
    assert vq.encode(df.where("false"), parts=4).count() == 0 and vq.encode(df.where("vec_id = 600"), parts=4).count() == 0


def test_nearest_settles_what_float32_cannot():
    rng = np.random.default_rng(3)
    entries = rng.integers(-(1 << 23), 1 << 23, (40, 5))
    entries[7], entries[9] = entries[3] + [0, 0, 0, 0, 1], entries[3]  # neighbours, and a tie for the lower index
    block = np.vstack([entries + rng.integers(-2, 3, entries.shape), rng.integers(-(1 << 23), 1 << 23, (60, 5)), np.zeros((1, 5), np.int64)])
    code, error = vq.nearest(block, entries)
    exact = ((block[:, None] - entries[None]) ** 2).sum(2)
    assert (code == exact.argmin(1)).all() and (error == exact.min(1)).all()
    float_only = (entries.astype(np.float32) ** 2).sum(1) - 2 * (block.astype(np.float32) @ entries.astype(np.float32).T)
    assert (float_only.argmin(1) != code).any()  # the screen alone would be wrong


def plain_top(rows, k, every):
    kept = [(i, as_ints(v)) for i, v, _ in rows if whole(v)]
    dim = max(len(v) for _, v in kept)
    kept = [(i, v + [0] * (dim - len(v))) for i, v in kept]
    out = []
    for at, (i, v) in enumerate(kept):
        if i is not None and i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0) for other, (j, w) in enumerate(kept) if other != at)
            out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(scores[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [32768, 40])
def test_top_products_against_plain_python(hard_vectors, monkeypatch, block_rows):
    rows, df = hard_vectors
    monkeypatch.setattr(inner, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(inner, "GROWTH", 2)
    assert sorted((tuple(r) for r in inner.top_products(df).collect()), key=repr) == plain_top(rows, 5, 50)
    if block_rows == 40:
        few = [r for r in rows if r[0] in (0, 50, 100)]
        some = df.where("vec_id in (0, 50, 100)")
        assert sorted((tuple(r) for r in inner.top_products(some).collect()), key=repr) == plain_top(few, 5, 50)
        assert inner.top_products(df.where("false")).count() == 0 and inner.top_products(df.where("vec_id = 600")).count() == 0


def test_pruning_loses_no_product(monkeypatch):
    rng = np.random.default_rng(8)
    v = (rng.normal(0, 60, (900, 24)) * np.exp(rng.normal(0, 1, (900, 1))) * np.r_[np.full(4, 5.0), np.ones(20)]).astype(np.int64)
    v[400:480] = v[17]
    ids = rng.permutation(900)
    turn = np.linalg.svd((v.T @ v).astype(float))[0]
    for slab in (64, 1024):
        monkeypatch.setattr(inner, "SLAB", slab)
        for known in (False, True):
            q, q_row = v[:70], np.arange(70)
            full = q @ v.T
            full[np.arange(70), np.arange(70)] = np.iinfo(np.int64).min
            want = [sorted((-full[i, j], ids[j]) for j in range(900) if j != i)[:5] for i in range(70)]
            floor = np.array([-w[4][0] for w in want], float) if known else np.full(70, -np.inf)
            behind = np.array([w[4][1] for w in want]) if known else np.zeros(70, np.int64)
            place, _, vid, score = inner.best_of(q, q_row, floor, behind, v, np.arange(900), ids, turn, 5)
            got = defaultdict(list)
            for i, a, s in zip(place, vid, score, strict=True):
                got[i].append((-s, a))
            assert [got[i] for i in range(70)] == want


def test_vectors_beyond_a_long_take_no_part():
    import pyarrow as pa

    kept, ints = vectors.integers(pa.array([[1.0, -0.001], None, [1e30, 0.0], [65535.9, 1.0], [0.5]], pa.list_(pa.float32())), 2)
    assert kept.tolist() == [0, 3, 4] and ints.tolist() == [[256, -1], [math.floor(float(np.float32(65535.9)) * 256), 256], [128, 0]]


# --- conversations

WHITE = " \t\n\v\f\r"


def plain_damage(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c] += []
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out[c] += [] if kind == 0 else [(t, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rs in out.items()}


def plain_repair(rows):
    """Cheapest and then least audit by a search over whole audits."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best[i, state] = True
        if i == len(rows) and state in ("", "a"):
            turns = {t for t, _, _ in rows if t is not None}
            pairs = [(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:], strict=False)]
            counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
            illegal = sum(p not in (("s", "u"), ("u", "a"), ("a", "u")) for p in pairs)
            return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        onward = [x for x in step[state] if x != "s"][0]
        heapq.heappush(heap, (cost + 5, audit + "I", i, onward, (*lines, f"{name[onward]}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                if role[:1] in step[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, onward, (*lines, f"{name[onward]}:{text}")))


def test_conversations_against_a_search_over_audits(spark):
    rng = random.Random(12)
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 9)):
            role = rng.choices(["system", "user", "assistant", "tool", "", None], [1, 5, 5, 0.5, 0.2, 0.2])[0]
            text = rng.choice(["One. Two!", "cut off", "Fine?", "Same words.", " \t\n", "", None, "Ends here. \n", "é " + "x" * 70 + rng.choice("ab.")])
            rows.append((c if c else None, rng.choice([t, t, t, t + 3, t - 5, None]), role, text))
    rows += [rows[20], rows[21], rows[21]]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", "word " * 40000 + ".") for t in range(4)]
    gone = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Lost."))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumns({c: F.lit("z") for c in ("seq", "gone", "kind", "copy", "letters", "c", "first", "audit", "start")})
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_conversations(df).collect()}
    want = {c: plain_repair(rs) for c, rs in plain_damage(rows).items()}
    assert got == want
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_conversations(df.where("false")).count() == 0


def test_blocks_of_long_conversations_agree(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 7, 8, 9, 40, 61):
        letters = "".join(rng.choice(repair.LETTERS) for _ in range(n))
        whole_way = repair.cheapest_edits(letters)
        monkeypatch.setattr(repair, "BLOCK", 8)
        assert repair.cheapest_edits(letters) == whole_way
        monkeypatch.undo()


def test_a_hot_conversation(spark):
    rows = [(5, t, "user" if t % 2 else "assistant", f"Turn {t % 50}.") for t in range(9000)] + [(6, 0, "user", "Hi."), (6, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_conversations(df).collect()}
    assert got == {c: plain_repair(rs) for c, rs in plain_damage(rows).items()}
