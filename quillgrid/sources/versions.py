"""Stored versions of a table, its profiles, and the logs around them, as Parquet.

    <root>/data/<project>/<kind>/<write>       table versions, kind raw or cleaned
    <root>/profiles/<project>/<kind>/<write>   one profile document each
    <root>/<name>/write=<write>                cleaning log, facts and forecasts, by run or version
    <root>/published/                          which write of a thing is the current one, appended

Nothing is written over. A write goes to a folder of its own and counts once a row in
`published` points to it, so a reader sees the last whole write, before, during and after
the next one, and a failed write leaves the old one as it was. Writing a run or a version
again replaces it.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.errors import TableError
from quillgrid.functions.parsing import column
from quillgrid.operators.cleaning import Cleaned
from quillgrid.operators.forecast import Forecast
from quillgrid.operators.profile import TableProfile
from quillgrid.operators.small import small_frame
from quillgrid.sources.scratch import remove

# --- Fixed values ------------------------------------------------------------
RAW, CLEANED, BEST = "raw", "cleaned", "best"
PREVIEW_ROWS = 100
# -----------------------------------------------------------------------------

_PLAIN = (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
_PUBLISHED = "thing string, write string, number bigint"
#: One row per forecast period of a run, whatever keys its series have.
FORECASTS = (
    "project string, run bigint, metric string, frequency string, horizon int, series map<string,string>, h int, period date, model string, "
    "backtest_mape double, mean double, lo80 double, hi80 double, lo95 double, hi95 double"
)


def storable(frame: DataFrame) -> DataFrame:
    """Nested and binary columns become text, as every stored column is a plain one."""
    return frame.select(
        *[
            (column(f.name) if isinstance(f.dataType, _PLAIN) else column(f.name).cast("string")).alias(f.name)
            for f in frame.schema.fields
        ]
    )


def preview(frame: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in the order of the columns that have one."""
    unordered = (T.MapType, T.VariantType)
    return frame.orderBy(*[column(f.name) for f in frame.schema.fields if not isinstance(f.dataType, unordered)]).limit(rows)


class VersionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- What counts ---------------------------------------------------------

    def published(self) -> DataFrame:
        """thing, write: the current write of each."""
        try:
            rows = self.spark.read.schema(_PUBLISHED).parquet(f"{self.root}/published")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], _PUBLISHED)
        # A tie of two writers goes to one of them, the same for every reader.
        return rows.groupBy("thing").agg(F.max(F.struct("number", "write")).alias("last")).select("thing", "last.number", "last.write")

    def _current(self, thing: str) -> str | None:
        row = self.published().where(F.col("thing") == thing).first()
        return row and row["write"]

    def _publish(self, thing: str, write: str) -> None:
        last = self.published().where(F.col("thing") == thing).first()
        row = (thing, write, last["number"] + 1 if last else 1)
        small_frame(self.spark, [row], _PUBLISHED).coalesce(1).write.mode("append").parquet(f"{self.root}/published")

    @staticmethod
    def _new_write() -> str:
        return f"w{uuid.uuid4().hex}"

    def _read(self, thing: str) -> DataFrame | None:
        write = self._current(thing)
        return None if write is None else self.spark.read.parquet(f"{self.root}/{thing}/{write}")

    def _replace(self, thing: str, frame: DataFrame) -> None:
        write = self._new_write()
        frame.write.parquet(f"{self.root}/{thing}/{write}")
        self._publish(thing, write)

    def _replace_part(self, name: str, part: str, frame: DataFrame) -> None:
        """One part (a run, a version) of a table of many."""
        write = self._new_write()
        frame.write.parquet(f"{self.root}/{name}/write={write}")
        self._publish(f"{name}/{part}", write)

    def _read_parts(self, name: str) -> DataFrame | None:
        try:
            rows = self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{name}")
        except AnalysisException as problem:
            if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        current = self.published().where(F.startswith("thing", F.lit(f"{name}/"))).select("write")
        return rows.join(current, "write", "left_semi").drop("write")

    # --- Tables ---------------------------------------------------------------

    def write_raw(self, project: str, frame: DataFrame, quota_bytes: int | None = None) -> None:
        """The raw version is written once; a second write is refused, and one that would pass the store's quota."""
        thing = f"data/{project}/{RAW}"
        write = self._current(thing) or self._new_write()
        folder = f"{self.root}/{thing}/{write}"
        storable(frame).write.mode("errorifexists").parquet(folder)
        if quota_bytes is not None:
            used, incoming = self.stored_bytes(), self._bytes([folder])
            if used + incoming > quota_bytes:
                remove(self.spark, folder)
                raise TableError(f"{incoming} bytes of {project} on top of {used} pass the quota of {quota_bytes}")
        self._publish(thing, write)

    def stored_bytes(self) -> int:
        """Size of the current table versions."""
        current = self.published().where(F.startswith("thing", F.lit("data/"))).collect()
        return self._bytes([f"{self.root}/{r['thing']}/{r['write']}" for r in current])

    def _bytes(self, folders: list[str]) -> int:
        if not folders:
            return 0
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders)
        return listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    def write_cleaned(self, project: str, frame: DataFrame) -> None:
        self._replace(f"data/{project}/{CLEANED}", storable(frame))

    def read(self, project: str, kind: str = BEST) -> DataFrame:
        for k in (CLEANED, RAW) if kind == BEST else (kind,):
            frame = self._read(f"data/{project}/{k}")
            if frame is not None:
                return frame
        raise TableError(f"no {kind} version of {project}")

    def best_kind(self, project: str) -> str:
        return RAW if self._current(f"data/{project}/{CLEANED}") is None else CLEANED

    # --- What was found out about them ------------------------------------------

    def write_profile(self, project: str, kind: str, profile: TableProfile) -> None:
        self._replace(f"profiles/{project}/{kind}", small_frame(self.spark, [(profile.to_json(),)], "profile_json string"))

    def read_profile(self, project: str, kind: str = RAW) -> TableProfile | None:
        stored = self._read(f"profiles/{project}/{kind}")
        return None if stored is None else TableProfile.from_json(stored.first()["profile_json"])

    def append_log(self, project: str, run: int, cleaned: Cleaned) -> None:
        entries = cleaned.log_frame(self.spark).withColumn("run", F.lit(run).cast("bigint"))
        self._replace_part(f"cleaning_log/{project}", str(run), entries)

    def read_log(self, project: str) -> DataFrame:
        """All steps ever applied, in the order they ran."""
        stored = self._read_parts(f"cleaning_log/{project}")
        if stored is None:
            raise TableError(f"no cleaning log for {project}")
        return stored.orderBy("run", "step")

    def replace_facts(self, version: str, name: str, facts: DataFrame) -> None:
        """Facts of one dataset version replace only that version's earlier ones."""
        self._replace_part(f"facts/{name}", version, facts.withColumn("version", F.lit(version)))

    def read_facts(self, name: str) -> DataFrame:
        stored = self._read_parts(f"facts/{name}")
        if stored is None:
            raise TableError(f"no facts named {name}")
        return stored

    def append_forecast(self, project: str, run: int, metric: str, made: Forecast) -> None:
        """One run of a project: what was forecast, how far, by which model, with what error in the backtest."""
        keys = made.keys
        series = F.create_map(*[x for k in keys for x in (F.lit(k), column(k).cast("string"))]) if keys else F.create_map()
        known = {
            "project": F.lit(project), "run": F.lit(run), "metric": F.lit(metric), "frequency": F.lit(made.frequency),
            "horizon": F.lit(made.horizon), "series": series,
        }
        cells = [known.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(FORECASTS)]
        self._replace_part("forecasts", f"{project}/{run}", made.forecast.select(*cells))

    def read_forecasts(self) -> DataFrame:
        stored = self._read_parts("forecasts")
        return self.spark.createDataFrame([], FORECASTS) if stored is None else stored
