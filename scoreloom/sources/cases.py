"""Readers and writers of case data: folders of volumes and reports, manifests, JSON lines, CSV, versioned tables."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import group_of, normalize

VOLUME_SUFFIX = r"(?i)\.(nii\.gz|nii|mha|mhd|nrrd)$"
MANIFEST = "case_id string, center string, volume string, report_count int"
CORPUS = "case_id string, center string, reports array<string>, reference string, phrases array<string>"
PAIR = "prediction string, reference string"
MOST_CHARACTERS = 20_000


def has_volume_suffix(path: Column) -> Column:
    return F.lower(path).rlike(VOLUME_SUFFIX)


def strip_suffix(name: Column) -> Column:
    return F.regexp_replace(name, VOLUME_SUFFIX, "")


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, file, folder of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.element_at(F.split("path", "/"), -2).alias("folder"))


def resolve_root(spark: SparkSession, root: str, depth: int = 4) -> str:
    """Below root while a folder has one folder and nothing else in it, up to depth times."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for _ in range(depth):
        inside = fs.listStatus(at)
        if len(inside) != 1 or not inside[0].isDirectory():
            break
        at = inside[0].getPath()
    return at.toString()


def first_existing(paths: DataFrame, candidates: list[str]) -> DataFrame:
    """The path whose last name comes first among the candidates, if any."""
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.element_at(F.split("path", "/"), -1))
    return paths.withColumn("_r", rank).where(F.col("_r") > 0).groupBy().agg(F.min_by("path", "_r").alias("path"))


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """case_id, volume, report_paths of case folders, or of flat folders volumes and reports_en: a full outer join, so that
    cases with one side only have a row too."""
    files = scan_tree(spark, root)
    flat = F.col("folder").isin("volumes", "reports_en")
    stem = F.regexp_replace(strip_suffix(F.col("file")), r"(?i)([._-]\d+)?\.txt$", "")
    named = files.withColumn("case_id", F.when(flat, stem).otherwise(F.when(F.col("folder") == "reports", F.element_at(F.split("path", "/"), -3)).otherwise(F.col("folder"))))
    volumes = named.where(has_volume_suffix(F.col("path"))).groupBy("case_id").agg(F.min("path").alias("volume"))
    reports = named.where(F.lower("path").endswith(".txt")).groupBy("case_id").agg(F.sort_array(F.collect_list("path")).alias("report_paths"))
    return volumes.join(reports, "case_id", "full_outer")


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, report: whole text files, folders being searched for .txt files, without a byte order mark, in normal form; empty
    ones are left out."""
    raw = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[tT][xX][tT]").select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", normalize(F.regexp_replace("value", "^\\uFEFF", "")).alias("report")).where("report <> ''")


def status(case: Column, volume: Column, reports: Column) -> Column:
    n = F.coalesce(F.size(reports), F.lit(0))
    return F.when(volume.isNotNull() & (n > 0), "complete").when(volume.isNotNull(), "volume_only").when(n > 0, "report_only").otherwise("empty")


def integrity_profile(found: DataFrame, examples: int = 20) -> DataFrame:
    """status, cases, examples (first ids): never raises."""
    s = found.withColumn("status", status(F.col("case_id"), F.col("volume"), F.col("report_paths")))
    counts = s.groupBy("status").agg(F.count("*").alias("cases"))
    from pyspark.sql import Window as W

    first = s.withColumn("_r", F.row_number().over(W.partitionBy("status").orderBy("case_id"))).where(F.col("_r") <= examples)
    return counts.join(first.groupBy("status").agg(F.sort_array(F.collect_list("case_id")).alias("examples")), "status")


def layout_counts(found: DataFrame) -> DataFrame:
    """Cases by group and number of reports."""
    return found.groupBy(group_of(F.col("case_id")).alias("center"), F.coalesce(F.size("report_paths"), F.lit(0)).alias("reports")).agg(F.count("*").alias("cases"))


def strict_cases(found: DataFrame, require_reports: bool = True, shown: int = 8) -> DataFrame:
    """The complete cases in order of folded ids; raises with the first ids of those that are not."""
    bad = found.where(F.col("volume").isNull() | (F.lit(require_reports) & (F.coalesce(F.size("report_paths"), F.lit(0)) == 0)))
    ids = [r["case_id"] for r in bad.select("case_id").orderBy("case_id").limit(shown).collect()]
    if ids:
        raise ValueError(f"incomplete cases: {', '.join(ids)}")
    return found.withColumn("center", group_of(F.col("case_id"))).orderBy(F.lower("case_id"))


def valid_cases(cases: DataFrame) -> DataFrame:
    """cases; a blank id, no report or a blank report raises when the row is read."""
    good = (F.length(F.btrim("case_id")) > 0) & (F.size("reports") > 0) & F.forall("reports", lambda r: F.length(F.btrim(r)) > 0)
    return cases.where(F.assert_true(good, F.lit("a case needs an id and reports that are not blank")).isNull())


def manifest(cases: DataFrame, root: str = "") -> DataFrame:
    """One row a case without any report text; paths below root become relative."""
    volume = F.when(F.col("volume").startswith(root), F.substring("volume", F.lit(len(root) + 1), F.length("volume"))).otherwise(F.col("volume")) if root else F.col("volume")
    return cases.select("case_id", group_of(F.col("case_id")).alias("center"), volume.alias("volume"), F.size("report_paths").alias("report_count"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.schema(CORPUS).json(path).where("case_id is not null")
    if out.isEmpty():
        raise ValueError(f"no cases in {path}")
    return out


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """prediction, reference of JSON lines; a line that has not both as strings raises, with the line's text."""
    rows = spark.read.schema(f"{PAIR}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    bad = rows.where("_bad is not null or prediction is null or reference is null").limit(1).collect()
    if bad:
        raise ValueError(f"not a pair: {bad[0]['_bad'] or bad[0]}")
    return rows.drop("_bad")


def anonymized_board(spark: SparkSession, path: str, required: list[str], keep: list[str], label: str = "Entry-%02d") -> DataFrame:
    """The kept columns of a CSV board, trimmed, entries renamed by their place."""
    from pyspark.sql import Window as W

    board = spark.read.csv(path, header=True)
    missing = sorted(set(required) - set(board.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    numbered = board.withColumn("_n", F.row_number().over(W.orderBy(F.col("position").cast("int"), F.monotonically_increasing_id())))
    return numbered.select(*[F.btrim(F.col(c)).alias(c) for c in keep], F.format_string(label, "_n").alias("anonymous_entry"))


def write_versioned(df: DataFrame, path: str, version: int) -> None:
    df.withColumn("format_version", F.lit(version)).write.mode("overwrite").parquet(path)


def read_versioned(spark: SparkSession, path: str, version: int) -> DataFrame:
    df = spark.read.parquet(path)
    other = df.where(F.col("format_version") != version).select("format_version").limit(1).collect()
    if other or "format_version" not in df.columns:
        raise ValueError(f"{path}: format {other[0][0] if other else None}, {version} is read")
    return df.drop("format_version")


def matrix_to_rows(wide: DataFrame, case: str = "case_id", keep_zero: bool = False) -> DataFrame:
    """case_id, proto, value of a table with a column per statement."""
    columns = [c for c in wide.columns if c != case]
    long = wide.select(case, F.explode(F.array(*[F.struct(F.lit(c).alias("proto"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")).select(case, "e.*")
    return long if keep_zero else long.where("value <> 0")


def stale_caches(requested: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Requested cases without a cache row of the same grid and version: those to be made (anew)."""
    same = [requested[k].eqNullSafe(cached[k]) for k in ["case_id", *keys]]
    return requested.join(cached, same, "left_anti")


def cache_report(requested: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """cases, missing, stale, ok of a cache against what is requested."""
    c = cached.select("case_id", *[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_there"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = requested.join(c, "case_id", "left").groupBy().agg(F.count("*").alias("cases"), F.count_if(F.col("_there").isNull()).alias("missing"), F.count_if(F.col("_there").isNotNull() & ~same).alias("stale"))
    return both.withColumn("ok", (F.col("missing") == 0) & (F.col("stale") == 0))


class GridCache:
    """Prepared cases in parts, of which a manifest tells the valid ones. A refresh makes only what is missing or stale, as a
    part beside the others, and publishes it by a new manifest under the next number; until then, and if the write is
    killed, readers find the cache as it was. Of a case in several parts the latest counts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        folder = self._path(f"{self.root}/manifests")
        return sorted(n for x in self._fs.listStatus(folder) if (n := x.getPath().getName()).endswith(".parts")) if self._fs.exists(folder) else []

    def parts(self) -> list[str]:
        """The valid parts, the latest last."""
        found = self._manifests()
        if not found:
            return []
        return [r["value"] for r in self.spark.read.text(f"{self.root}/manifests/{found[-1]}").collect() if r["value"]]

    def read(self) -> DataFrame | None:
        """The cached cases; null for none."""
        whole = None
        for k, part in enumerate(self.parts()):
            rows = self.spark.read.parquet(f"{self.root}/parts/{part}").withColumn("_part", F.lit(k))
            whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
        if whole is None:
            return None
        latest = whole.groupBy("case_id").agg(F.max("_part").alias("_latest")).withColumnRenamed("case_id", "_case")
        return whole.join(latest, (F.col("case_id") == F.col("_case")) & (F.col("_part") == F.col("_latest"))).drop("_case", "_part", "_latest")

    def refresh(self, requested: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> int:
        """Makes the requested cases (case_id and keys) that have no row of the same keys; how many those were."""
        cached = self.read()
        todo = requested if cached is None else stale_caches(requested, cached, keys)
        n = todo.count()
        if n:
            part = uuid.uuid4().hex
            make(todo).write.parquet(f"{self.root}/parts/{part}")
            self._publish([*self.parts(), part])
        return n

    def _publish(self, parts: list[str]) -> None:
        found = self._manifests()
        number = int(found[-1].split(".")[0]) + 1 if found else 0
        staged = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(staged)
        out.write(bytearray("\n".join(parts).encode()))
        out.close()
        # a name that is taken is not taken over: of two refreshes at a time the later must begin anew
        target = self._path(f"{self.root}/manifests/{number:09d}.parts")
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            raise RuntimeError(f"{target} has been published by another")


def challenge_output(reports: DataFrame, text: str = "report", most: int = MOST_CHARACTERS) -> DataFrame:
    """reports with output, a JSON object of the one key report; empty, overlong or NUL-holding reports raise when read."""
    t = F.btrim(F.col(text))
    good = (F.length(t) > 0) & (F.length(t) <= most) & ~F.contains(t, F.lit("\0"))
    checked = reports.where(F.assert_true(F.coalesce(good, F.lit(False)), F.lit("a report must be 1 to 20000 characters without NUL")).isNull())
    return checked.withColumn("output", F.to_json(F.struct(t.alias("report"))))


def parse_output(output: Column) -> Column:
    """The report of such an object; null if it has any other key or none."""
    return F.when(F.json_object_keys(output) == F.array(F.lit("report")), F.get_json_object(output, "$.report"))


def single_input(files: DataFrame, first_of_many: bool = False) -> str:
    """The one volume path; raises if there is none, or more than one unless the first is asked for."""
    found = [r["path"] for r in files.where(has_volume_suffix(F.col("path"))).orderBy("path").limit(2).collect()]
    if not found or (len(found) > 1 and not first_of_many):
        raise ValueError(f"one volume is needed, {len(found) or 'none'} found")
    return found[0]


def synthetic_cases(spark: SparkSession, cases: int, templates: list[tuple[str, float, float]], seed: int = 2026) -> DataFrame:
    """case_id, center, latent, reports: each template (text, prevalence, signal) is stated with a chance that rises with the
    case's latent factor; one to three reports a case. Hash-based, so the same on every run and at every partitioning."""
    u = lambda *k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *k)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    ids = spark.range(cases).withColumn("center", F.element_at(F.array(*[F.lit(c) for c in "PFSA"]), (F.col("id") % 4 + 1).cast("int")))
    base = ids.withColumn("case_id", F.format_string("%s%03d", "center", "id")).withColumn("latent", 2 * u(F.col("case_id"), F.lit("z")) - 1)
    said = []
    for k, (text, prevalence, signal) in enumerate(templates):
        logit = F.log(F.lit(prevalence / (1 - prevalence))) + signal * F.col("latent")
        said.append(F.when(u(F.col("case_id"), F.lit(f"t{k}")) < 1 / (1 + F.exp(-logit)), F.lit(text)))
    report = F.array_join(F.array_compact(F.array(*said)), " ")
    count = (F.floor(u(F.col("case_id"), F.lit("n")) * 3) + 1).cast("int")
    return base.select("case_id", "center", "latent", F.array_repeat(report, count).alias("reports"))


def nested_record(props: Column, schema: T.DataType | str) -> Column:
    return F.from_json(props, schema)


def results_table(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several result tables under one another, with the variant each comes from; missing columns are null."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """A Markdown table row (column line) per row of df."""
    cells = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.col(c).cast("string")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def check_config(given: dict, known: dict) -> dict:
    """known, overlaid with given; a key that is not known raises."""
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return {k: check_config(given.get(k, {}), v) if isinstance(v, dict) else given.get(k, v) for k, v in known.items()}


def load_config(path: str, known: dict) -> dict:
    with open(path, encoding="utf-8") as f:
        return check_config(json.load(f), known)


#: Names of settings in the environment: this before the setting in capitals.
ENVIRONMENT = "SCORELOOM_"


def dotenv(path: str) -> dict[str, str]:
    """NAME=value lines of a file; blank lines and those that begin with # are left out, as are quotes around a value and
    `export` before a name. A line of any other form raises."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for number, line in enumerate(f, 1):
            line = line.strip().removeprefix("export ").strip()
            if not line or line.startswith("#"):
                continue
            name, sign, value = line.partition("=")
            if not sign or not name.strip().isidentifier():
                raise ValueError(f"{path}:{number}: not NAME=value")
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def overridden(known: dict, given: dict[str, str] | None = None) -> dict:
    """known, with settings that the environment (or given) has under ENVIRONMENT and the name in capitals; values are JSON, or
    else text."""
    given = os.environ if given is None else given

    def read(text: str):
        try:
            return json.loads(text)
        except ValueError:
            return text

    return {k: read(given[name]) if (name := f"{ENVIRONMENT}{k.upper()}") in given else v for k, v in known.items()}


def with_provenance(parts: dict[str, DataFrame], columns: list[str], about: dict[str, str] | None = None) -> DataFrame:
    """Result tables under one another: variant, source (what about says of the variant), place (in the order of the parts),
    and the columns, those that a part lacks being null."""
    out = None
    for place, (name, df) in enumerate(parts.items()):
        held = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns]
        one = df.select(F.lit(name).alias("variant"), F.lit((about or {}).get(name)).cast("string").alias("source"), F.lit(place).alias("place"), *held)
        out = one if out is None else out.unionByName(one)
    return out
