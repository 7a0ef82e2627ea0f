"""The set-wise training/evaluation flow for all eligible sessions (§7.2 slice).

sessions (F1) ⋈ packets (J1) → profile: label index (A2) + bitmap per channel →
fit pass: md5 split (R1), per-class sufficient statistics and exact values of
candidate channels → channel categories (A3) and naive Bayes (M1) → indexed
test rows (P7, P8) scored (M6) → prediction pairs → metrics (A4-A11).

Per-session side tables (sessions, spec, models) have one bounded row per
eligible session, so one row-count probe on the sessions table decides
whether they are broadcast; beyond the bound every join is a shuffle join.
Those tables are small and feed several branches (fit and scoring), so they
are materialised as tables in the shared checkpoint folder: computed once,
and never recomputed after an executor loss. The packets themselves are
scanned by three passes: the profile (label counts, bitmap per channel), the
fit pass (per-class sufficient statistics plus exact values of the
candidate channels, from which category maps and naive Bayes follow), and
scoring. With statistics that ingest keeps up (``operators.session_stats``) the
first two are merges of small tables, and only scoring scans packets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigclass.functions.labels import decode
from sigclass.operators import metrics, naive_bayes, prepare
from sigclass.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, small_enough
from sigclass.operators.session_stats import SessionStatistics
from sigclass.schemas import MAX_CATEGORIES, N_CHANNELS, TRAIN_PERCENT
from sigclass.session import materialize


@dataclass
class Flow:
    calibrations: DataFrame
    packets: DataFrame
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS
    train_percent: int = TRAIN_PERCENT
    max_categories: int = MAX_CATEGORIES
    n_channels: int = N_CHANNELS
    statistics: SessionStatistics | None = None
    _cache: dict = field(default_factory=dict)

    def _memo(self, name, fn):
        if name not in self._cache:
            self._cache[name] = fn()
        return self._cache[name]

    @property
    def sessions(self) -> DataFrame:
        """Eligible session ids (F1), materialised."""
        return self._memo("sessions", lambda: materialize(
            prepare.eligible_calibrations(self.calibrations).select("calibrationid"), "sessions"))

    @property
    def small_sessions(self) -> bool:
        """One probe: are there few enough eligible sessions to broadcast per-session tables?"""
        return self._memo("small", lambda: small_enough(self.sessions, self.max_broadcast_rows))

    @property
    def frame(self) -> DataFrame:
        return self._memo("frame", lambda: prepare.training_frame(
            self.sessions, self.packets, self.max_broadcast_rows, self.small_sessions))

    @property
    def profile(self) -> DataFrame:
        """Label counts + per-channel bounds of distinct values per session (one pass), materialised."""
        return self._memo("profile", lambda: materialize(
            self.statistics.profile(self.sessions) if self.statistics else prepare.session_profile(
                self.frame, self.n_channels), "profile"))

    @property
    def invalid(self) -> DataFrame:
        """Packets of eligible sessions that cannot be used: calibrationid, reason, n."""
        return self.statistics.invalid(self.sessions) if self.statistics else prepare.invalid_packets(self.frame)

    @property
    def fit_summary(self) -> DataFrame:
        """Second and last training pass: per-class statistics + candidate channel values."""
        return self._memo("fit_summary", lambda: materialize(
            self.statistics.fit_summary(self.sessions, self.profile, self.max_categories)
            if self.statistics else prepare.fit_pass(
                self.frame, self.profile, self.max_categories, self.n_channels, self.train_percent,
                self.small_sessions), "fit_summary"))

    @property
    def codes(self) -> DataFrame:
        """A3: category codes of every categorical channel, from the fit pass."""
        return self._memo("codes", lambda: prepare.categories_from_fit_pass(
            self.fit_summary, self.max_categories))

    @property
    def spec(self) -> DataFrame:
        """Per-session (labels, cat_maps), materialised."""
        def build():
            labels = prepare.label_orders(prepare.label_index_fit(None, self.profile))
            maps = prepare.category_maps(self.codes)
            return materialize(labels.join(maps, "calibrationid", "left"), "spec")
        return self._memo("spec", build)

    @property
    def indexed(self) -> DataFrame:
        return self._memo("indexed", lambda: prepare.indexed_frame(
            self.frame, self.spec, self.train_percent, self.max_broadcast_rows, self.small_sessions))

    @property
    def nb_params(self) -> DataFrame:
        """M1 from the fit pass's sufficient statistics (no further scan of the packets).

        A session with a value that is not finite fails, as MLlib rejects such input."""
        def build():
            stats = prepare.class_statistics(self.fit_summary, self.codes, self.spec, self.n_channels)
            stats = stats.join(self.profile.select("calibrationid", "n_not_finite"), "calibrationid")
            stats = stats.withColumn("bad", F.when(F.col("n_not_finite") > 0, 1).otherwise(F.col("bad")))
            return naive_bayes.from_statistics(stats.drop("n_not_finite"), self.n_channels)
        return self._memo("nb_params", build)

    @property
    def nb_models(self) -> DataFrame:
        return self._memo("nb_models", lambda: materialize(
            naive_bayes.models(self.nb_params), "nb_models"))

    @property
    def nb_predictions(self) -> DataFrame:
        """Test rows with prediction (class index) and decoded predicted_label."""
        def build():
            test = self.indexed.where(~F.col("is_train"))
            x = [f"x{i}" for i in range(self.n_channels)]
            s = naive_bayes.score(test, self.nb_models, features=x, broadcast=self.small_sessions).drop(*x)
            return s.withColumn("predicted_label", decode("prediction", "labels"))
        return self._memo("nb_predictions", build)

    def pairs(self, model: str = "nb") -> DataFrame:
        p = self.nb_predictions
        return p.select("calibrationid", F.lit(model).alias("model"),
                        F.col("label_idx").alias("actual"), F.col("prediction").alias("predicted"))

    def nb_status(self) -> DataFrame:
        """(calibrationid, ok, error) of every eligible session with packets: it fails without
        training rows, and with a negative value or one that is not finite."""
        s = self.profile.select("calibrationid", "n_not_finite").join(
            self.nb_models.select("calibrationid", "ok"), "calibrationid", "left")
        error = (F.when(F.col("n_not_finite") > 0, F.lit("feature that is not finite"))
                 .when(F.col("ok").isNull(), F.lit("no training rows"))
                 .when(~F.col("ok"), F.lit("negative feature")))
        return s.select("calibrationid", error.isNull().alias("ok"), error.alias("error"))

    def report(self) -> DataFrame:
        return metrics.report(self.pairs("nb"))
