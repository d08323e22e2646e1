"""Splits and small models: folds, priors, one-vs-rest logistic gates, geometry features, nearest neighbours, mixtures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.written import materialize



def hash_order(key: Column, seed: int) -> Column:
    """A shuffle that other engines reproduce: MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def stratified_folds(cases: DataFrame, group: str, k: int = 5, seed: int = 2026, case: str = "case_id") -> DataFrame:
    """case, group, fold: members of each group dealt round, each group from an offset of its own."""
    place = F.row_number().over(W.partitionBy(group).orderBy(hash_order(F.col(case), seed), case)) - 1
    offset = F.conv(F.substring(hash_order(F.col(group), seed), 1, 8), 16, 10).cast("long")
    return cases.select(case, group).withColumn("fold", F.pmod(place + offset, F.lit(k)).cast("int"))


def fold_roles(folds: DataFrame, k: int) -> DataFrame:
    """Every case in every fold as train or validation."""
    return folds.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("role", F.when(F.col("split") == F.col("fold"), "validation").otherwise("train"))


def leave_one_group_out(cases: DataFrame, group: str, case: str = "case_id") -> DataFrame:
    """A split for each group (numbered in order of names), in which its cases are held out. Groups are few."""
    groups = cases.select(group).distinct()
    numbered = groups.select(F.col(group).alias("held_out"), (F.row_number().over(W.orderBy(group)) - 1).alias("split"))
    return cases.select(case, group).join(numbered).withColumn("role", F.when(F.col(group) == F.col("held_out"), "validation").otherwise("train"))


def prior(cases: DataFrame, bank: DataFrame) -> DataFrame:
    """Each case given every statement's prevalence."""
    return cases.crossJoin(bank.select("proto", F.col("prevalence").alias("p")))


def prior_report(bank: DataFrame, threshold: float, most: int) -> DataFrame:
    """The most prevalent statements at or above the threshold."""
    return bank.where(F.col("prevalence") >= threshold).orderBy(F.desc("prevalence"), "proto").limit(most)


def assemble_oof(cases: DataFrame, bank: DataFrame, slices: DataFrame) -> DataFrame:
    """case_id, proto, p, covered: fold slices laid over the prior."""
    return prior(cases, bank).withColumnRenamed("p", "prevalence").join(slices.select("case_id", "proto", "p"), ["case_id", "proto"], "left").select("case_id", "proto", F.coalesce("p", "prevalence").alias("p"), F.col("p").isNotNull().alias("covered"))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, float]:
    """L2 logistic regression with balanced class weights, penalty |w|^2/2 + c * sum of weighted losses, by Newton steps."""
    n, d = x.shape
    weight = np.where(y == 1, n / (2 * max(y.sum(), 1)), n / (2 * max((1 - y).sum(), 1)))
    a = np.column_stack([x, np.ones(n)])
    ridge = np.append(np.ones(d), 0.0)
    w = np.zeros(d + 1)
    loss = lambda v: c * (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ v))).sum() + 0.5 * (ridge * v * v).sum()
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        slope = c * a.T @ (weight * (p - y)) + ridge * w
        curve = c * (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        t = 1.0
        while t > 1e-6 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
        before, now = now, loss(w)
        if before - now < 1e-10 * (1 + abs(now)):
            break
    return w[:-1], float(w[-1])


#: Numbers in one task's sums of second derivatives; statements are fitted in as many goes as that asks for.
CURVE_NUMBERS = 1 << 22
#: Tasks whose sums are merged.
MERGED_TASKS = 256


class _Gates:
    """Logistic gates of many units (a statement, or a statement without a fold) fitted together.

    A task goes through its cases once and adds up, for every unit, loss, slope and curve of the penalised loss at the weights
    it is given; the sums of tasks are merged and each unit takes its Newton step on the driver. What moves is sums,
    never features, and their size is that of the model."""

    def __init__(self, table: DataFrame, protos: list, folds: list, c: float, least: int) -> None:
        """table: case_id, f, fold, labels (protos); folds: those left out, None for none."""
        self.table, self.c, self.units = table, c, [(p, k) for k in folds for p in protos]
        moments = self._moments()
        self.n = {k: sum(n for g, (n, _, _) in moments.items() if g != k or k is None) for k in folds}
        self.mean, self.scale = {}, {}
        some = next(iter(moments.values()), (0, np.zeros(0), np.zeros(0)))
        for k in folds:
            kept = [m for g, m in moments.items() if g != k or k is None]
            n = max(self.n[k], 1)
            mean = sum((m[1] for m in kept), np.zeros_like(some[1])) / n
            # squares were summed about the mean of all, so that no digits cancel
            var = sum((m[2] for m in kept), np.zeros_like(some[2])) / n - mean**2
            std = np.sqrt(np.maximum(var, 0))
            self.mean[k], self.scale[k] = mean + self.centre, np.where(std > 1e-9, std, 1.0)
        counts = table.select("fold", F.explode("labels").alias("proto")).groupBy("proto", "fold").agg(F.count("*").alias("n")).collect()
        self.positives = {u: sum(r["n"] for r in counts if r["proto"] == u[0] and (u[1] is None or r["fold"] != u[1])) for u in self.units}
        self.fitted = [u for u in self.units if least <= self.positives[u] <= self.n[u[1]] - least and self.n[u[1]]]
        self.weights: dict[tuple, np.ndarray] = {}
        wide = len(self.mean[folds[0]]) + 1
        each = max(1, CURVE_NUMBERS // wide**2)
        for at in range(0, len(self.fitted), each):
            self._fit(self.fitted[at : at + each], wide)

    def _moments(self) -> dict:
        """By fold: cases, sum and sum of squares of the features about their mean over all cases."""
        first = self.table.select(F.posexplode("f").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m")).orderBy("k").collect()
        self.centre = centre = np.array([r["m"] for r in first])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict = {}
            for b in batches:
                x = np.stack(b.column("f").to_numpy(zero_copy_only=False)) - centre if b.num_rows else np.zeros((0, len(centre)))
                fold = np.asarray(b.column("fold"))
                for k in np.unique(fold):
                    own = x[fold == k]
                    n, s, q = out.get(int(k), (0, 0, 0))
                    out[int(k)] = (n + len(own), s + own.sum(0), q + (own**2).sum(0))
            columns = [[k for k in out], [v[0] for v in out.values()], [v[1].tolist() for v in out.values()], [v[2].tolist() for v in out.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["fold", "n", "s", "q"])

        parts = self.table.select("f", "fold").coalesce(MERGED_TASKS).mapInArrow(sums, "fold int, n long, s array<double>, q array<double>").collect()
        out: dict = {}
        for r in parts:
            n, s, q = out.get(r["fold"], (0, 0, 0))
            out[r["fold"]] = (n + r["n"], s + np.array(r["s"]), q + np.array(r["q"]))
        return out

    def _sums(self, units: list, at: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Loss, slope and curve of each unit at its weights (standardised, the intercept last), without the penalty."""
        mean, scale, positives, n, c = self.mean, self.scale, self.positives, self.n, self.c
        folds = list(dict.fromkeys(k for _, k in units))
        column = {p: [] for p, _ in units}
        for i, (p, _) in enumerate(units):
            column[p].append(i)
        up = np.array([n[k] / (2 * max(positives[p, k], 1)) for p, k in units])
        down = np.array([n[k] / (2 * max(n[k] - positives[p, k], 1)) for p, k in units])
        wide = at.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope, curve = np.zeros(len(units)), np.zeros((len(units), wide)), np.zeros((len(units), wide, wide))
            for b in batches:
                if not b.num_rows:
                    continue
                x, fold = np.stack(b.column("f").to_numpy(zero_copy_only=False)), np.asarray(b.column("fold"))
                y = np.zeros((b.num_rows, len(units)))
                for row, labels in enumerate(b.column("labels").to_pylist()):
                    for p in labels or ():
                        y[row, column.get(p, [])] = 1
                for k in folds:
                    own = [i for i, (_, left_out) in enumerate(units) if left_out == k]
                    kept = np.ones(len(x), bool) if k is None else fold != k
                    z = np.column_stack([(x[kept] - mean[k]) / scale[k], np.ones(kept.sum())])
                    is_y = y[np.ix_(kept, own)]
                    weight = c * np.where(is_y == 1, up[own], down[own])
                    linear = z @ at[own].T
                    p = 1 / (1 + np.exp(-np.clip(linear, -60, 60)))
                    loss[own] += (weight * np.logaddexp(0, np.where(is_y == 1, -linear, linear))).sum(0)
                    slope[own] += (weight * (p - is_y)).T @ z
                    bend = weight * np.maximum(p * (1 - p), 1e-9)
                    for j, i in enumerate(own):
                        curve[i] += (z * bend[:, j : j + 1]).T @ z
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(units))), pa.array(loss), pa.array([v.tobytes() for v in slope], pa.binary()), pa.array([v.tobytes() for v in curve], pa.binary())], ["unit", "loss", "slope", "curve"])

        def merged(rows: pa.Table) -> pa.Table:
            total = [sum(np.frombuffer(v) for v in rows.column(c).to_pylist()).tobytes() for c in ("slope", "curve")]
            return pa.table([rows.column("unit")[:1], pa.array([float(np.sum(rows.column("loss").to_numpy()))]), *(pa.array([v], pa.binary()) for v in total)], ["unit", "loss", "slope", "curve"])

        schema = "unit long, loss double, slope binary, curve binary"
        parts = self.table.select("f", "fold", "labels").coalesce(MERGED_TASKS).mapInArrow(run, schema)
        rows = {r["unit"]: r for r in parts.groupBy("unit").applyInArrow(merged, schema).collect()}
        return [(rows[i]["loss"], np.frombuffer(rows[i]["slope"]), np.frombuffer(rows[i]["curve"]).reshape(wide, wide)) for i in range(len(units))]

    def _fit(self, units: list, wide: int, rounds: int = 100) -> None:
        """Newton steps, halved where they don't help, of all units at once; a unit that stands still leaves."""
        ridge = np.append(np.ones(wide - 1), 0.0)
        now = {u: (np.zeros(wide), *s) for u, s in zip(units, self._sums(units, np.zeros((len(units), wide))), strict=True)}
        whole = lambda w, loss: loss + 0.5 * (ridge * w * w).sum()
        left = {u: 1.0 for u in units}
        for _ in range(rounds):
            if not left:
                break
            steps = {u: np.linalg.solve(curve + np.diag(ridge + 1e-9), slope + ridge * w) for u, (w, _, slope, curve) in now.items() if u in left}
            tried, size = dict(left), {}
            best: dict = {}
            while tried:
                at = {u: now[u][0] - t * steps[u] for u, t in tried.items()}
                for u, s in zip(at, self._sums(list(at), np.array(list(at.values()))), strict=True):
                    t = tried[u]
                    if whole(at[u], s[0]) <= whole(now[u][0], now[u][1]) or t / 2 <= 1e-6:
                        best[u] = (at[u], *s)
                    else:
                        size[u] = t / 2
                tried, size = size, {}
            for u, new in best.items():
                before, after = whole(now[u][0], now[u][1]), whole(new[0], new[1])
                now[u] = new
                if before - after < 1e-10 * (1 + abs(after)):
                    left.pop(u)
        self.weights |= {u: v[0] for u, v in now.items()}


def _labelled(features: DataFrame, labels: DataFrame, folds: DataFrame | None) -> DataFrame:
    """case_id, f, fold, labels: one row a case."""
    own = labels.select("case_id", "proto").distinct().groupBy("case_id").agg(F.collect_list("proto").alias("labels"))
    table = features.join(folds.select("case_id", F.col("fold").cast("int").alias("fold")), "case_id") if folds is not None else features.withColumn("fold", F.lit(0))
    return materialize(table.select("case_id", F.col("f").cast("array<double>").alias("f"), "fold").join(own, "case_id", "left"), "gate_cases")


def out_of_fold(features: DataFrame, labels: DataFrame, folds: DataFrame, bank: DataFrame, *, c: float = 1.0, least: int = 3) -> DataFrame:
    """case_id, proto, p, y: each statement's gate fitted without the fold that it scores. features: case_id, f; labels: sparse
    case_id, proto; folds: case_id, fold. Columns that some training set can't fit keep that set's share of positives.

    All gates are fitted together from mergeable sums (see _Gates); a case is then scored where it lies."""
    table = _labelled(features, labels, folds)
    protos = [r["proto"] for r in bank.select("proto").orderBy("proto").collect()]
    names = [r["fold"] for r in table.select("fold").distinct().orderBy("fold").collect()]
    gates = _Gates(table, protos, names, c, least) if names else None
    parts = {}
    for k in names:
        w = np.array([gates.weights.get((p, k), np.zeros(len(gates.mean[k]) + 1)) for p in protos])
        share = np.array([gates.positives[p, k] / gates.n[k] if gates.n[k] else 0.0 for p in protos])
        parts[k] = (gates.mean[k], gates.scale[k], w, share, np.array([(p, k) in gates.weights for p in protos]))
    kinds = {"case_id": dict(table.dtypes)["case_id"], "proto": dict(bank.dtypes)["proto"]}
    place = {p: i for i, p in enumerate(protos)}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, own in batch.groupby("fold"):
                mean, scale, w, share, fitted = parts[k]
                z = np.column_stack([(np.stack(own["f"]) - mean) / scale, np.ones(len(own))])
                p = np.where(fitted, 1 / (1 + np.exp(-np.clip(z @ w.T, -60, 60))), share)
                y = np.zeros(p.shape, np.int32)
                for row, said in enumerate(own["labels"]):
                    for proto in said if said is not None else ():
                        if proto in place:
                            y[row, place[proto]] = 1
                yield pd.DataFrame({"case_id": np.repeat(own["case_id"].to_numpy(), len(protos)), "proto": np.tile(protos, len(own)), "p": p.ravel(), "y": y.ravel()})

    return table.mapInPandas(score, f"case_id {kinds['case_id']}, proto {kinds['proto']}, p double, y int")


def fit_gates(features: DataFrame, labels: DataFrame, bank: DataFrame, *, c: float = 1.0, least: int = 3) -> DataFrame:
    """proto, weights, intercept, mean, scale, fitted: one gate a statement over all cases; the prior where none is fitted."""
    table = _labelled(features, labels, None)
    known = {r["proto"]: r["prevalence"] for r in bank.select("proto", "prevalence").orderBy("proto").collect()}
    gates = _Gates(table, list(known), [None], c, least)
    rows = []
    for p, prevalence in known.items():
        q = min(max(float(prevalence), 1e-6), 1 - 1e-6)
        w = gates.weights.get((p, None))
        rows.append((p, w[:-1].tolist() if w is not None else [0.0] * len(gates.mean[None]), float(w[-1]) if w is not None else float(np.log(q / (1 - q))), gates.mean[None].tolist(), gates.scale[None].tolist(), w is not None))
    return bank.sparkSession.createDataFrame(rows, f"proto {dict(bank.dtypes)['proto']}, weights array<double>, intercept double, mean array<double>, scale array<double>, fitted boolean")


def header_features(shape: Column, spacing: Column) -> Column:
    """Nine numbers of an image header: ln(1+size), spacing, ln(1+extent), for each axis."""
    extent = F.zip_with(shape, spacing, lambda a, b: a * b)
    return F.concat(F.transform(shape, lambda x: F.log1p(x.cast("double"))), spacing, F.transform(extent, lambda x: F.log1p(x)))


def robust_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, median, scale: half the spread between quartiles' ends; the standard deviation where that is 0, 1 where both are."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*").where("x is not null")
    q = long.groupBy("column").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.stddev_pop("x").alias("sd"))
    iqr = F.element_at("q", 3) - F.element_at("q", 1)
    return q.select("column", F.element_at("q", 2).alias("median"), F.when(iqr > 1e-6, iqr).when(F.col("sd") > 1e-6, F.col("sd")).otherwise(1.0).alias("scale"))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns less their mean over their population standard deviation (1 where that is 0), in one pass and a broadcast row."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    out = df.crossJoin(stats)
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 1e-9, F.col(f"_s_{c}")).otherwise(1.0))
    return out.select(*df.columns)


def histogram(df: DataFrame, value: str, bins: int = 16, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """bin, n: equal bins, the last closed; values outside are left out."""
    at = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


#: Vectors of the smallest blocks, numbers that the largest hold, queries and items whose products a task holds at a time, and
#: pairs that it keeps to be measured.
BLOCK, NUMBERS, STRIP, KEPT = 4096, 1 << 23, (256, 1024), 1 << 20


def _same_names(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of all pairs of equal names."""
    codes = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    a, b = codes[: len(a)], codes[len(a) :]
    order = np.argsort(b, kind="stable")
    first, last = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    n = last - first
    return np.repeat(np.arange(len(a)), n), order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]


def _measured(a: np.ndarray, b: np.ndarray, place: np.ndarray, r: np.ndarray, c: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the pairs (rows r of a, rows c of b) each row's of least squared distance, of equals the least place; distances.
    Differences are taken in the vectors' own precision and their squares summed in order."""
    d = np.zeros(len(r))
    for k in range(a.shape[1]):
        z = (a[r, k] - b[c, k]).astype(np.float64)
        d += z * z
    order = np.lexsort((place[c], d, r))
    first = order[np.concatenate([[True], r[order][1:] != r[order][:-1]])] if len(r) else order
    return r[first], c[first], about[first], d[first]


def _nearest_of(a: np.ndarray, b: np.ndarray, barred: tuple[np.ndarray, np.ndarray] | None, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a (query) the row of b of least squared distance that is not barred (rows of a, rows of b), of equals
    the least place: rows of a, rows of b, distances.

    Items go by length, strip by strip. Products in single precision estimate a.b - b.b / 2, which is greatest for the nearest,
    to a bound of each query and strip; what may be the greatest is measured."""
    dims, (tall, wide) = a.shape[1], STRIP
    mean = b.mean(0, dtype=np.float64)
    norms = [np.concatenate([((v[i : i + 65536] - mean) ** 2).sum(1) for i in range(0, len(v), 65536)]) for v in (a, b)]
    order = np.argsort(norms[1], kind="stable")
    b, place, half = b[order], place[order], norms[1][order] / 2
    y = np.empty((dims + 1, len(b)), np.float32)
    for i in range(0, len(b), 65536):
        y[:dims, i : i + 65536] = (b[i : i + 65536] - mean).T
    y[dims] = -half
    tiles = -(-len(b) // wide)
    if barred is not None:
        where = np.empty(len(b), np.int64)
        where[order] = np.arange(len(b))
        br, bc = barred[0], where[barred[1]]
        tile = br // tall * tiles + bc // wide
        by = np.argsort(tile, kind="stable")
        br, bc, tile = br[by], bc[by], tile[by]
    # sums of dims + 1 products of rounded numbers, and a distance of rounded differences, err by less; so does taking off the mean
    whole = np.sqrt((mean * mean).sum())
    out, room = [], np.empty(tall * wide, np.float32)
    for s in range(0, len(a), tall):
        n = np.sqrt(norms[0][s : s + tall])
        x = np.ones((len(n), dims + 1), np.float32)
        x[:, :dims] = a[s : s + tall] - mean
        least, held, many = np.full(len(n), -np.inf), [], 0

        def settled(held: list[tuple[np.ndarray, ...]], slack: list[np.ndarray], least: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
            r, c, about = (np.concatenate(v) for v in zip(*held, strict=True))
            good = about + np.concatenate(slack) >= least[r]
            return _measured(a[start : start + tall], b, place, r[good], c[good], about[good])

        slack = []
        for k in range(tiles):
            t = slice(k * wide, (k + 1) * wide)
            part = y[:, t]
            about = np.matmul(x, part, out=room[: len(x) * part.shape[1]].reshape(len(x), -1))
            if barred is not None:
                i, j = np.searchsorted(tile, [s // tall * tiles + k, s // tall * tiles + k + 1])
                about[br[i:j] - s, bc[i:j] - k * wide] = -np.inf
            far = n + np.sqrt(2 * half[t][-1])
            err = (dims + 16) * 2.0**-24 * far * far + 2.0**-49 * (far + whole) * far + 1e-35
            high = about.max(1).astype(np.float64)
            least = np.maximum(least, high - err)
            r = np.flatnonzero((high + err >= least) & np.isfinite(high))
            if not len(r):
                continue
            i, c = np.nonzero(about[r] >= (least[r] - err[r])[:, None])
            r = r[i]
            held.append((r, c + k * wide, about[r, c].astype(np.float64)))
            slack.append(err[r])
            many += len(r)
            if many > KEPT:
                # of what is measured the nearest stays, as sure to be measured again as it was
                r, c, about, _ = settled(held, slack, least, s)
                held, slack, many = [(r, c, about)], [np.full(len(r), np.inf)], 0
        if held:
            r, c, _, d = settled(held, slack, least, s)
            out.append((r + s, order[c], d))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(queries: DataFrame, index: DataFrame, dims: int, others: bool = False) -> DataFrame:
    """query, match, distance: least mean squared difference, the first of equals. queries: query, v; index: item, v.
    others: an item of the query's own name is no match.

    Blocks of queries meet blocks of items, each pair of blocks in a task: products estimate all its distances with a bound
    on their error, and what may be nearest is measured as `distance` has it. Blocks are as many as give all cores work, or
    as hold NUMBERS numbers at most; each is sent once for each block of the other side. Vectors that are not `dims` plain
    numbers are few and go by `distance` alone."""
    plain = lambda v: F.coalesce((F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(F.abs(x) < 1e15, F.lit(False))), F.lit(False))
    items = index.withColumnRenamed("v", "w")
    if others:
        queries, items = queries.where("query is not null"), items.where("item is not null")
    d = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b).cast("double") * (a - b).cast("double")), F.lit(0.0), lambda a, x: a + x) / float(dims)
    odd = queries.crossJoin(items.where(~plain("w"))).unionByName(queries.where(~plain("v")).crossJoin(items.where(plain("w"))))
    odd = (odd.where(F.col("query") != F.col("item")) if others else odd).select("query", "item", d.alias("distance"))
    sides = [queries.where(plain("v")), items.where(plain("w"))]
    few = int(np.ceil(np.sqrt(4 * queries.sparkSession.sparkContext.defaultParallelism)))
    blocks = [max(1, -(-n // max(1, NUMBERS // dims)), min(-(-n // BLOCK), few)) for n in (s.count() for s in sides)]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sides[0].withColumn("_q", F.pmod(F.xxhash64("query"), F.lit(blocks[0])).cast("int")).withColumn("_i", every(blocks[1]))
    right = sides[1].withColumn("_i", F.pmod(F.xxhash64("item"), F.lit(blocks[1])).cast("int")).withColumn("_q", every(blocks[0]))
    left, right = (s.repartition(2 * blocks[0] * blocks[1], "_q", "_i") for s in (left, right))
    schema = StructType([left.schema["query"], right.schema["item"], StructField("distance", DoubleType())])

    def best(q: pa.Table, i: pa.Table) -> pa.Table:
        names, others_names = (np.asarray(t.column(c).to_numpy()) for t, c in ((q, "query"), (i, "item")))
        a, b = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) for t, c in ((q, "v"), (i, "w")))
        found = _nearest_of(a, b, _same_names(names, others_names) if others else None, np.unique(others_names, return_inverse=True)[1]) if len(a) and len(b) else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"query": q.column("query").take(pa.array(found[0])), "item": i.column("item").take(pa.array(found[1])), "distance": pa.array(found[2] / float(dims), pa.float64())})

    met = left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInArrow(best, schema)
    scored = met.unionByName(odd)
    return scored.groupBy("query").agg(F.min(F.struct("distance", "item")).alias("m")).select("query", F.col("m.item").alias("match"), F.col("m.distance").alias("distance"))


def pooled(values: Column, bins: int) -> Column:
    """Means of consecutive chunks, the first ones one longer where sizes don't divide."""
    n = F.size(values)
    begin = lambda i: i * F.floor(n / bins) + F.least(i, n % bins)
    part = lambda i: F.slice(values, (begin(i) + 1).cast("int"), (begin(i + 1) - begin(i)).cast("int"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: mean(part(i)))


def kmeans(features: DataFrame, column: str = "f", k: int = 4, seed: int = 2026) -> tuple[DataFrame, float]:
    """Rows with their cluster, and the cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = features.withColumn("_v", array_to_vector(F.col(column)))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(ready)
    return model.transform(ready).drop("_v"), float(model.summary.trainingCost)


def grouped_kmeans(features: DataFrame, group: str, k: int = 4, *, restarts: int = 4, rounds: int = 50, seed: int = 2026, column: str = "f") -> tuple[DataFrame, DataFrame]:
    """k-means fitted anew without each group, all fits in one plan. features: case_id, group, f (equally long).

    Returns routed (held_out, case_id, cluster, held: whether the case is of that group) and costs (held_out, cost, restart,
    centers), held_out null for the fit over all groups. Features are standardised by each fit's own cases. Each fit begins
    restarts times from the k cases of least hash, moves centres to the means of what is nearest (the lower number of
    equals; an empty cluster keeps its centre) until nothing moves or rounds are over, and keeps the restart of least
    cost. A round is one job over all cases: a task sends the sums of each fit's clusters."""
    cases = materialize(features.select("case_id", F.col(group).alias("g"), F.col(column).cast("array<double>").alias("f")), "kmeans_cases")
    long = cases.select("g", F.posexplode("f").alias("k", "x")).groupBy("g", "k").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).collect()
    groups = sorted({r["g"] for r in long}, key=lambda g: (g is None, g))
    dims = 1 + max((r["k"] for r in long), default=-1)
    fits: list = [*groups, None] if None not in groups else groups
    sums = {g: np.zeros((3, dims)) for g in groups}
    for r in long:
        sums[r["g"]][:, r["k"]] = r["n"], r["s"], r["q"]
    mean, scale, centers = {}, {}, {}
    for held in fits:
        n, s, q = sum((v for g, v in sums.items() if held is None or g != held), np.zeros((3, dims)))
        n = np.maximum(n, 1)
        std = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))
        mean[held], scale[held] = s / n, np.where(std > 1e-9, std, 1.0)
        own = cases if held is None else cases.where(~F.col("g").eqNullSafe(F.lit(held)))
        for r in range(restarts):
            first = own.orderBy(F.xxhash64(F.lit(seed + r), "case_id"), "case_id").limit(k).collect()
            if first:
                centers[held, r] = (np.array([x["f"] for x in first]) - mean[held]) / scale[held]
    schema = "fit int, cluster int, n long, cost double, s array<double>"
    keys = list(centers)

    def one_round() -> dict:
        at, mean_, scale_ = {u: centers[u] for u in keys}, mean, scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {(i, c): [0, 0.0, np.zeros(dims)] for i, u in enumerate(keys) for c in range(len(at[u]))}
            for b in batches:
                if not b.num_rows:
                    continue
                x, g = np.stack(b.column("f").to_numpy(zero_copy_only=False)), np.array(b.column("g").to_pylist(), object)
                for i, u in enumerate(keys):
                    z = (x if u[0] is None else x[g != u[0]]) - mean_[u[0]]
                    z = z / scale_[u[0]]
                    d = ((z[:, None] - at[u][None]) ** 2).sum(2)
                    near = d.argmin(1)
                    for c in np.unique(near):
                        t = total[i, int(c)]
                        t[0], t[1], t[2] = t[0] + int((near == c).sum()), t[1] + float(d[near == c, c].sum()), t[2] + z[near == c].sum(0)
            rows = [(i, c, n, cost, s.tolist()) for (i, c), (n, cost, s) in total.items() if n]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())), strict=True)], ["fit", "cluster", "n", "cost", "s"])

        parts = cases.select("g", "f").coalesce(MERGED_TASKS).mapInArrow(run, schema)
        whole = parts.groupBy("fit", "cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(dims)])
        return {(r["fit"], r["cluster"]): r for r in whole.collect()}

    cost: dict = {}
    for turn in range(rounds + 1):
        found = one_round() if keys else {}
        moved = False
        for i, u in enumerate(keys):
            cost[u] = sum(r["cost"] for (j, _), r in found.items() if j == i)
            for c in range(len(centers[u])):
                if (r := found.get((i, c))) is not None:
                    new = np.array([r[f"s{j}"] for j in range(dims)]) / r["n"]
                    moved |= bool(np.abs(new - centers[u][c]).max() > 1e-9)
                    if turn < rounds:
                        centers[u] = centers[u].copy()
                        centers[u][c] = new
        if not moved:
            break
    best = {held: min((cost[u], u[1]) for u in keys if u[0] == held) for held in fits if any(u[0] == held for u in keys)}
    chosen = {held: centers[held, r] for held, (_, r) in best.items()}

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["f"]) if len(batch) else np.zeros((0, dims))
            for held, at in chosen.items():
                near = ((((x - mean[held]) / scale[held])[:, None] - at[None]) ** 2).sum(2).argmin(1)
                yield pd.DataFrame({"held_out": held, "case_id": batch["case_id"], "cluster": near, "held": (batch["g"] == held) if held is not None else False})

    kinds = dict(cases.dtypes)
    routed = cases.mapInPandas(route, f"held_out {kinds['g']}, case_id {kinds['case_id']}, cluster int, held boolean")
    costs = cases.sparkSession.createDataFrame([(h, float(v), r, chosen[h].tolist()) for h, (v, r) in best.items()], f"held_out {kinds['g']}, cost double, restart int, centers array<array<double>>")
    return routed, costs


def mixture_scores(routed: DataFrame, reports: DataFrame, references: DataFrame) -> DataFrame:
    """routed: case_id, cluster; reports: cluster, prediction. Caption scores of each case's cluster's report, pooled."""
    from .metrics import caption_scores

    return caption_scores(references.join(routed, "case_id").join(reports, "cluster").select("case_id", "prediction", "reference"))


def fit_retrieval(features: DataFrame, reports: DataFrame) -> DataFrame:
    """case_id, v, report, mean, scale: features (case_id, f) standardised by place over all cases, each with its report; what
    saves and loads as a versioned table (`sources.cases.write_versioned`). Places without spread are left unscaled."""
    stats = features.select(F.posexplode("f").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    whole = stats.groupBy().agg(F.array_sort(F.collect_list(F.struct("k", "m", F.when(F.col("s") > 1e-9, F.col("s")).otherwise(1.0).alias("s")))).alias("stats"))
    of = lambda c: F.transform("stats", lambda x: x[c])
    # one row of sums for every case
    both = features.join(reports, "case_id").crossJoin(F.broadcast(whole.select(of("m").alias("mean"), of("s").alias("scale"))))
    return both.select("case_id", standard(F.col("f")).alias("v"), "report", "mean", "scale")


def standard(f: Column) -> Column:
    return F.zip_with(F.zip_with(f, F.col("mean"), lambda x, m: x - m), F.col("scale"), lambda d, s: d / s)


def retrieved(model: DataFrame, features: DataFrame, dims: int) -> DataFrame:
    """case_id, match, distance, report: each case's nearest fitted case, by `nearest`. features: case_id, f."""
    stats = F.broadcast(model.select("mean", "scale").limit(1))
    asked = features.crossJoin(stats).select(F.col("case_id").alias("query"), standard(F.col("f")).alias("v"))
    met = nearest(asked, model.select(F.col("case_id").alias("item"), "v"), dims)
    return met.join(model.select(F.col("case_id").alias("match"), "report"), "match").select(F.col("query").alias("case_id"), "match", "distance", "report")


def ensemble(cases: DataFrame, linear: DataFrame, networks: DataFrame, bank: DataFrame) -> DataFrame:
    """case_id, proto, p: the linear model's, else the mean of the networks', else the prior."""
    mean = networks.groupBy("case_id", "proto").agg(F.avg("p").alias("q"))
    base = prior(cases, bank).withColumnRenamed("p", "r")
    return base.join(linear.select("case_id", "proto", "p"), ["case_id", "proto"], "left").join(mean, ["case_id", "proto"], "left").select("case_id", "proto", F.coalesce("p", "q", "r").alias("p"))


