"""One project from files to a cleaned version: ingest, profile, suggest, clean, export."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.errors import ForecastError
from quillgrid.operators.cleaning import Step, clean_and_compare
from quillgrid.operators.facts import extract_facts
from quillgrid.operators.forecast import Forecast, check_eligibility, prepare_series, run_forecast
from quillgrid.operators.profile import TableProfile, profile_table
from quillgrid.operators.small import small_frame
from quillgrid.operators.suggest import suggest_cleaning
from quillgrid.sources.delimited import read_delimited, write_csv
from quillgrid.sources.versions import CLEANED, RAW, VersionStore


class Project:
    def __init__(self, store: VersionStore, name: str):
        self.store, self.name, self.spark = store, name, store.spark

    def ingest(self, paths: str | Sequence[str], quota_bytes: int | None = None) -> DataFrame:
        """Read the files and keep them as the raw version, which is never written again.

        With a quota, files that would take the store beyond it are refused and leave nothing behind.
        """
        self.store.write_raw(self.name, read_delimited(self.spark, paths), quota_bytes)
        return self.store.read(self.name, RAW)

    def profile(self, kind: str = RAW) -> TableProfile:
        """The stored profile of a version, computed on first use."""
        stored = self.store.read_profile(self.name, kind)
        if stored is None:
            stored = profile_table(self.store.read(self.name, kind))
            self.store.write_profile(self.name, kind, stored)
        return stored

    def suggestions(self) -> DataFrame:
        return suggest_cleaning(self.spark, self.profile())

    def clean(self, steps: Sequence[Step], run: int) -> DataFrame:
        """Clean the raw version. Nothing is stored unless every step succeeds."""
        raw = self.store.read(self.name, RAW)
        result, after, comparison = clean_and_compare(raw, list(steps), self.profile())
        self.store.write_cleaned(self.name, result.frame)
        self.store.write_profile(self.name, CLEANED, after)
        self.store.append_log(self.name, run, result)
        return comparison

    def facts(self) -> DataFrame | None:
        """All facts of the best version, replacing earlier ones of that version; returns those of metrics."""
        kind = self.store.best_kind(self.name)
        found = extract_facts(self.store.read(self.name, kind), self.profile(kind))
        version = f"{self.name}-{kind}"
        overview = [(k, None if v is None else str(v)) for k, v in found.overview.items()]
        tables = {
            "overview": small_frame(self.spark, overview, "name string, value string"),
            "metrics": found.metrics, "segments": found.segments, "anomalies": found.anomalies, "notes": found.notes, "dates": found.dates,
        }
        for name, rows in tables.items():
            if rows is not None:
                self.store.replace_facts(version, name, rows)
        return None if found.metrics is None else self.store.read_facts("metrics").where(F.col("version") == version)

    def forecast(self, metric: str, horizon: int, run: int) -> Forecast:
        """Forecast one metric of the best version and append the run."""
        kind = self.store.best_kind(self.name)
        frame, profile = self.store.read(self.name, kind), self.profile(kind)
        allowed = check_eligibility(frame, profile)
        if not allowed.eligible:
            raise ForecastError(allowed.reason)
        if metric not in allowed.metric_options:
            raise ForecastError(f"{metric!r} is not one of {allowed.metric_options}")
        result = run_forecast(prepare_series(frame, allowed.date_column, metric), horizon)
        self.store.append_forecast(self.name, run, metric, result)
        return result

    def export(self, path: str) -> None:
        write_csv(self.store.read(self.name), path)
