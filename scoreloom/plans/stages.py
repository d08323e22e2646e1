"""The stages from a folder of cases to scored reports. Each reads tables of the work folder and writes its own there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bank as B
from ..operators import additive, metrics, models, search, select
from ..sources import cases as S
from ..sources import volumes as V

GRID = [k / 20 for k in range(1, 19)]
LOCAL_GRID = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
FORMAT = 1


def _at(path: Column) -> Column:
    """A path without the scheme of local files, which readers spell differently."""
    return F.regexp_replace(path, "^file:/+", "/")


class Stages:
    """data: folder of cases (first stages only). work: folder of tables, shared by driver and executors."""

    def __init__(self, spark: SparkSession, work: str, data: str | None = None, *, least: int = 6, most: int = 26, least_support: int = 2, shape: list[int] | None = None, spacing: list[float] | None = None) -> None:
        self.spark, self.work, self.data = spark, work.rstrip("/"), data
        self.least, self.most, self.least_support = least, most, least_support
        self.shape, self.spacing = shape or [96, 192, 192], spacing or [0.8, 0.8, 0.8]

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.work}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.work}/{name}")

    def _found(self) -> DataFrame:
        if not self.data:
            raise ValueError("this stage needs the folder of cases")
        return S.discovered(self.spark, S.resolve_root(self.spark, self.data))

    def inspect(self) -> DataFrame:
        """Cases by what they have, with examples; raises for no content."""
        return S.integrity_profile(self._found())

    def index(self) -> DataFrame:
        """The manifest, as JSON lines; raises if a case is not complete."""
        S.write_json_lines(S.manifest(S.strict_cases(self._found())), f"{self.work}/manifest")
        return S.read_manifest(self.spark, f"{self.work}/manifest")

    def prepare(self, skip_errors: bool = False) -> DataFrame:
        """corpus (case_id, center, reports in compatibility form) and features (case_id, f) of the volumes; a volume that can't be read raises
        unless such cases are to go without features."""
        found = self._found()
        texts = T.composed(S.read_reports(self.spark, self.data), "report").withColumn("path", _at(F.col("path")))
        said = found.select("case_id", F.posexplode("report_paths").alias("k", "path")).withColumn("path", _at(F.col("path"))).join(texts, "path")
        corpus = said.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "report"))), lambda r: r["report"]).alias("reports"))
        corpus = self._write("corpus", corpus.select("case_id", S.group_of(F.col("case_id")).alias("center"), "reports"))
        read = V.read_volumes(self.spark, self.data).withColumn("volume", _at(F.col("path")))
        read = found.select("case_id", _at(F.col("volume")).alias("volume")).join(read, "volume")
        if not skip_errors:
            bad = [f"{r['case_id']}: {r['error']}" for r in read.where("error is not null").select("case_id", "error").limit(8).collect()]
            if bad:
                raise ValueError("; ".join(bad))
        self._write("features", V.descriptors(V.grids(read.where("error is null"), self.shape, self.spacing)))
        return corpus

    def prototypes(self) -> DataFrame:
        """bank, labels and coverage."""
        corpus = self.read("corpus")
        bank = self._write("bank", B.build(corpus, least_support=self.least_support))
        # read twice by the assignment: written once, as finding concepts is the dear part
        phrases = self._write("phrases", B.described(B.case_phrases(corpus)).select(F.struct("case_id", "seq").alias("id"), "words", "concepts"))
        assigned = self._write("assigned", B.assign(phrases, bank).select("id.case_id", "proto", "similarity"))
        self._write("labels", B.labels(assigned))
        return self._write("coverage", B.coverage(corpus, assigned))

    def splits(self, strategy: str = "stratified") -> DataFrame:
        """folds: dealt within each center, or one center a fold."""
        corpus = self.read("corpus")
        if strategy == "center":
            held = models.leave_one_group_out(corpus, "center").where("role = 'validation'")
            return self._write("folds", held.select("case_id", "center", F.col("split").cast("int").alias("fold")))
        return self._write("folds", models.stratified_folds(corpus, "center"))

    def train(self) -> DataFrame:
        """oof (case_id, proto, p): linear gates out of fold, the prior for cases without features."""
        corpus, bank = self.read("corpus"), self.read("bank")
        fitted = models.out_of_fold(self.read("features"), self.read("labels"), self.read("folds"), bank)
        return self._write("oof", models.assemble_oof(corpus, bank, fitted))

    def _scores(self, prior_only: bool) -> DataFrame:
        return models.prior(self.read("corpus").select("case_id"), self.read("bank")) if prior_only else self.read("oof").select("case_id", "proto", "p")

    def calibrate(self, prior_only: bool = False, rounds: int = 1) -> DataFrame:
        """thresholds: the ascent over the final score, all settings of a step in one job over one row a case."""
        bank, scores = select.render_order(self.read("bank")), self._scores(prior_only)
        refs = self.read("corpus").select("case_id", F.col("reports").alias("references"))
        table = additive.with_probabilities(additive.case_table(bank, refs), scores)
        protos = [r["proto"] for r in bank.orderBy(F.desc("prevalence"), "proto").select("proto").collect()]
        foes = [(r["i"], r["j"]) for r in self._foes().collect()]
        said, decoding = additive.statements_of(bank), additive.Decoding(protos, self.least, self.most, foes)

        def evaluate(settings: list[dict[int, float]]) -> list[float]:
            got = {r["trial"]: r["final"] for r in additive.score_settings(table, said, decoding, settings).select("trial", "final").collect()}
            return [got.get(k, 0.0) for k in range(len(settings))]

        found, trace = search.calibrate(dict.fromkeys(protos, 0.5), evaluate, grid=GRID, local_grid=LOCAL_GRID, order=protos if rounds else [], rounds=rounds)
        return self._write("thresholds", self.spark.createDataFrame([(p, t, trace[-1]) for p, t in found.items()], "proto int, thr double, final double"))

    def _foes(self) -> DataFrame:
        return select.contradictions(B.C.with_mentions(self.read("bank").select("proto", "text"), "text"))

    def _reports(self, prior_only: bool) -> DataFrame:
        return select.decoded_reports(self._scores(prior_only), self.read("thresholds").select("proto", "thr"), self.read("bank"), self._foes(), self.least, self.most)

    def evaluate(self, prior_only: bool = False) -> DataFrame:
        """scores of the decoded reports: clinical, captions, final."""
        reports = self._write("reports", self._reports(prior_only))
        refs = self.read("corpus").select("case_id", F.col("reports").alias("references"))
        return self._write("scores", metrics.challenge_scores(reports.select("case_id", F.col("report").alias("prediction")), refs))

    def ablation(self) -> DataFrame:
        """The prior and the model under the same thresholds on one scoring path."""
        refs = self.read("corpus").select("case_id", F.col("reports").alias("references"))
        one = lambda prior: metrics.challenge_scores(self._reports(prior).select("case_id", F.col("report").alias("prediction")), refs)
        return self._write("ablation", S.results_table({"prior": one(True), "model": one(False)}))

    def package(self) -> DataFrame:
        """What decoding needs, in one versioned table: each statement with its threshold and gate."""
        bank = self.read("bank")
        gates = models.fit_gates(self.read("features"), self.read("labels"), bank)
        whole = bank.select("proto", "text", "section", "prevalence").join(self.read("thresholds").select("proto", "thr"), "proto").join(gates, "proto", "left")
        S.write_versioned(whole, f"{self.work}/bundle", FORMAT)
        return S.read_versioned(self.spark, f"{self.work}/bundle", FORMAT)

    def predict(self, volume: str) -> DataFrame:
        """case_id, protos, report, output of new volumes (a file, or a folder of them), decoded with the packaged model; the
        case is named after its file. A volume that can't be read raises."""
        bundle = S.read_versioned(self.spark, f"{self.work}/bundle", FORMAT)
        read = V.read_volumes(self.spark, volume).withColumn("case_id", S.strip_suffix(F.element_at(F.split("path", "/"), -1)))
        bad = [f"{r['path']}: {r['error']}" for r in read.where("error is not null").select("path", "error").limit(8).collect()]
        if bad or read.isEmpty():
            raise ValueError("; ".join(bad) or f"no volume in {volume}")
        cases = V.descriptors(V.grids(read, self.shape, self.spacing))
        # the packaged statements are a short list that every case is given
        both = cases.crossJoin(F.broadcast(bundle.select("proto", "weights", "mean", "scale", "intercept", "fitted", "prevalence")))
        gate = select.gate_probability(F.col("f"), F.col("weights"), F.col("mean"), F.col("scale"), F.col("intercept"))
        scores = both.select("case_id", "proto", F.when(F.col("fitted"), gate).otherwise(F.col("prevalence")).alias("p"))
        foes = select.contradictions(B.C.with_mentions(bundle.select("proto", "text"), "text"))
        reports = select.decoded_reports(scores, bundle.select("proto", "thr"), bundle, foes, self.least, self.most)
        return S.challenge_output(reports)

    def run_all(self, strategy: str = "stratified", skip_errors: bool = False, skip_train: bool = False, rounds: int = 1) -> DataFrame:
        """prepare, prototypes, splits, train, calibrate, evaluate, package; the scores."""
        steps: list[Callable[[], object]] = [lambda: self.prepare(skip_errors), self.prototypes, lambda: self.splits(strategy)]
        steps += [] if skip_train else [self.train]
        for step in [*steps, lambda: self.calibrate(skip_train, rounds), lambda: self.evaluate(skip_train), self.package]:
            step()
        return self.read("scores")
