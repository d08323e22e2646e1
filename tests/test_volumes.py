"""Volume files, grids and descriptors against plain numpy."""

import gzip
import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.sources import cases as S
from scoreloom.sources import volumes as V


def nifti(array, spacing, slope=0.0, shift=0.0):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *array.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<8f", head, 76, 1, *spacing[::-1], 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, slope, shift)
    return bytes(head) + array.astype("<i2").tobytes()


def meta(array, spacing, packed):
    body = array.astype("<f4").tobytes()
    lines = ["ObjectType = Image", "NDims = 3", "DimSize = " + " ".join(map(str, array.shape[::-1])), "ElementSpacing = " + " ".join(map(str, spacing[::-1])), f"CompressedData = {packed}", "ElementType = MET_FLOAT", "ElementDataFile = LOCAL"]
    return "\n".join(lines).encode() + b"\n" + (zlib.compress(body) if packed else body)


def test_files_grids_and_descriptors(spark, tmp_path):
    rng = np.random.default_rng(3)
    array = rng.integers(-900, 2500, (9, 11, 13)).astype(np.float32)
    spacing = [0.5, 0.25, 0.75]
    files = {"a.nii": nifti(array, spacing), "b.nii.gz": gzip.compress(nifti(array, spacing, 2.0, -3.0)), "c.mha": meta(array, spacing, False), "d.mha": meta(array, spacing, True), "e.nii": b"broken", "f.mha": b"DimSize = 1"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = V.read_volumes(spark, str(tmp_path)).withColumn("case_id", F.regexp_extract("path", r"([a-f])\.[^/]*$", 1)).cache()
    rows = {r["case_id"]: r for r in read.collect()}
    for k in "abcd":
        want = array * 2 - 3 if k == "b" else array
        assert rows[k]["error"] is None and rows[k]["spacing"] == pytest.approx(spacing)
        assert np.array_equal(np.frombuffer(rows[k]["voxels"], "<f4").reshape(rows[k]["shape"]), want)
    assert all(rows[k]["error"] and rows[k]["shape"] is None for k in "ef")
    heads = {r["path"].rpartition("/")[2]: r for r in V.read_headers(spark, str(tmp_path)).collect()}
    assert {n for n, r in heads.items() if r["error"]} == {"e.nii", "f.mha"} and all(heads[n]["shape"] == [9, 11, 13] and heads[n]["spacing"] == pytest.approx(spacing) for n in ("a.nii", "b.nii.gz", "c.mha", "d.mha"))

    good = read.where("error is null")
    grids = V.grids(good, [6, 14, 8], spacing).cache()
    low, high = np.percentile(array, (0.5, 99.5))
    unit = (np.clip(array, low, high) - low) / (high - low)
    one = {r["case_id"]: r for r in grids.collect()}["a"]
    assert one["foreground"] == pytest.approx((unit > 0.55).mean()) and one["original_shape"] == [9, 11, 13]
    kept = np.frombuffer(one["voxels"], "<f2").reshape(6, 14, 8)
    # 11 of 14 rows are the volume's, one zero row before and two after them
    assert not kept[:, 0].any() and not kept[:, 12:].any()
    box = [unit[z : z + 6, :, x : x + 8].astype(np.float16) for z in range(4) for x in range(6)]
    assert any(np.allclose(kept[:, 1:12], b, atol=2e-3) for b in box)
    assert [(r["shape"], r["cases"]) for r in V.grid_shapes(grids).collect()] == [([6, 14, 8], 4)]

    f = {r["case_id"]: r["f"] for r in V.descriptors(grids).collect()}
    data = kept.astype(np.float32)
    assert len(f["a"]) == 10 + 9 + 16 + 3 + 3 * (12 + 16)
    assert f["a"][:3] == pytest.approx(np.log1p([9, 11, 13]) / 8) and f["a"][10:19] == pytest.approx(np.quantile(data, V.QUANTILES), abs=1e-5)
    plane = [c.mean() for r in np.array_split(data.mean(axis=2), 4) for c in np.array_split(r, 4, axis=1)]
    assert f["a"][-16:] == pytest.approx(plane, abs=1e-5)

    g = {r["case_id"]: r["f"] for r in V.volume_features(good).collect()}
    assert len(g["a"]) == 85 and g["a"][3:6] == pytest.approx(np.log1p(spacing)) and g["a"][9] == 0 and g["a"][17] == 1
    assert g["a"] == pytest.approx(g["d"]) and sum(g["a"][21:37]) == pytest.approx(1)


def test_resampling_and_windows():
    line = np.arange(5, dtype=np.float32).reshape(1, 1, 5)
    out = V.resampled(line, [1, 1, 1], [1, 1, 0.5]).ravel()
    assert out.tolist() == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 0]
    assert V.resampled(line, [1, 1, 1], [1, 1, 1]) is line
    dense = np.zeros((20, 20, 20), np.float32)
    dense[14, 3, 10] = 1
    assert V.window(dense, [4, 4, 4])[2, 2, 2] == 1
    assert V.window(np.zeros((2, 2, 2), np.float32), [4, 4, 4]).shape == (4, 4, 4)
    with pytest.raises(ValueError):
        V.scaled(np.full((4, 4, 4), np.nan), (0.5, 99.5))


def test_headers_cost_the_same_however_large(spark, tmp_path):
    (tmp_path / "small.mha").write_bytes(meta(np.zeros((2, 3, 4), np.float32), [1, 1, 1], False))
    (tmp_path / "large.mha").write_bytes(meta(np.zeros((90, 100, 110), np.float32), [1, 2, 3], False))
    (tmp_path / "large.nii.gz").write_bytes(gzip.compress(nifti(np.random.default_rng(0).integers(-900, 900, (90, 100, 110)).astype(np.float32), [1, 2, 3])))
    heads = {r["path"].rpartition("/")[2]: r for r in V.read_headers(spark, str(tmp_path)).collect()}
    assert heads["large.mha"]["length"] > 3_900_000 and heads["large.mha"]["shape"] == heads["large.nii.gz"]["shape"] == [90, 100, 110]
    assert all(r["error"] is None and r["bytes_read"] <= V.HEAD_BYTES for r in heads.values()) and heads["small.mha"]["axes"] == [1, 2, 3]


def placed(array, spacing, order, back, kind):
    """The volume (z, y, x along the patient's axes) as a file whose axes are the patient's in another order, some the other way."""
    by_x = array.transpose(2, 1, 0).transpose(order)
    by_x = by_x[tuple(slice(None, None, -1 if b else 1) for b in back)]
    rows = np.zeros((3, 3))
    for own, (world, b) in enumerate(zip(order, back)):
        rows[own, world] = -1 if b else 1
    # a little off the axes, as scanners are
    tilt = np.array([[1, 0.08, 0], [-0.08, 1, 0.05], [0, -0.05, 1]])
    rows = rows @ tilt
    stored, own_spacing = by_x.transpose(2, 1, 0), [spacing[::-1][w] for w in order][::-1]
    if kind == "mha":
        data = meta(stored, own_spacing, False)
        return data.replace(b"ElementType", b"TransformMatrix = " + " ".join(map(str, rows.ravel())).encode() + b"\nElementType")
    data = bytearray(nifti(stored, own_spacing))
    columns = rows.T * [[-1], [-1], [1]]
    if kind == "matrix":
        struct.pack_into("<2h", data, 252, 0, 1)
        for k, at in enumerate((280, 296, 312)):
            struct.pack_into("<4f", data, at, *(columns[k] * own_spacing[::-1]), 0)
        return bytes(data)
    # the nearest rotation as a quaternion, a mirrored one by the sign
    u, _, v = np.linalg.svd(columns)
    turn = u @ v
    sign = -1.0 if np.linalg.det(turn) < 0 else 1.0
    turn = turn * [1, 1, sign]
    skew = np.array([[turn[2, 1] - turn[1, 2]], [turn[0, 2] - turn[2, 0]], [turn[1, 0] - turn[0, 1]]]).ravel()
    values, vectors = np.linalg.eigh(np.block([[turn + turn.T - np.trace(turn) * np.eye(3), skew[:, None]], [skew[None], np.trace(turn).reshape(1, 1)]]))
    b, c, d, a = vectors[:, -1] * (1 if vectors[3, -1] >= 0 else -1)
    struct.pack_into("<2h", data, 252, 1, 0)
    struct.pack_into("<f", data, 76, sign)
    struct.pack_into("<3f", data, 256, b, c, d)
    return bytes(data)


def test_all_orientations_give_one_grid(spark, tmp_path):
    rng = np.random.default_rng(11)
    array, spacing = rng.integers(-900, 2500, (6, 7, 8)).astype(np.float32), [0.5, 0.75, 1.0]
    for n, order in enumerate(itertools.permutations(range(3))):
        for m, back in enumerate(itertools.product((False, True), repeat=3)):
            for kind in ("mha", "matrix", "quaternion"):
                (tmp_path / f"{kind}{n}{m}.{'mha' if kind == 'mha' else 'nii'}").write_bytes(placed(array, spacing, order, back, kind))
    read = V.read_volumes(spark, str(tmp_path)).withColumn("case_id", F.col("path"))
    assert read.where("error is not null").isEmpty() and read.count() == 144
    grids = V.grids(read, [5, 6, 7], [0.5, 0.75, 1.0]).select("voxels", "low", "high").distinct()
    assert grids.count() == 1
    as_stored = V.read_volumes(spark, str(tmp_path), turn=False)
    assert as_stored.select("voxels").distinct().count() == 48
    assert V.patient_axes(np.zeros((3, 3))) == V.patient_axes(None) == [(0, False), (1, False), (2, False)]


def test_cache_is_remade_in_part(spark, tmp_path):
    cache, made = S.GridCache(spark, str(tmp_path / "cache")), []

    def make(todo):
        made.append(sorted(r["case_id"] for r in todo.collect()))
        return todo.withColumn("data", F.concat_ws("/", "case_id", F.col("size").cast("string")))

    def broken(todo):
        bad = todo.withColumn("data", F.raise_error(F.lit("killed")).cast("string"))
        bad.write.parquet(str(tmp_path / "cache" / "parts" / "half"))
        return bad

    want = spark.createDataFrame([(c, 1) for c in "abc"], "case_id string, size int")
    assert cache.read() is None and cache.refresh(want, ["size"], make) == 3 and cache.refresh(want, ["size"], make) == 0
    other = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "case_id string, size int")
    before = cache.read().orderBy("case_id").collect()
    with pytest.raises(Exception, match="killed"):
        cache.refresh(other, ["size"], broken)
    assert cache.read().orderBy("case_id").collect() == before
    assert cache.refresh(other, ["size"], make) == 2 and made == [["a", "b", "c"], ["b", "d"]]
    assert [tuple(r) for r in cache.read().orderBy("case_id").collect()] == [("a", 1, "a/1"), ("b", 2, "b/2"), ("c", 1, "c/1"), ("d", 1, "d/1")]
    assert cache.refresh(other, ["size"], make) == 0 and len(cache.parts()) == 2
