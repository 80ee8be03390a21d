"""Stage tables in shared storage: lineage cuts, saved stages, and the stage and run ledgers."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_STAGE_LEDGER = (
    "table_name string, at bigint, created_at timestamp, row_count bigint, rows_written bigint, "
    "description string, path string, replaces boolean, deleted boolean, build string, batch bigint, batches bigint, fields string"
)
_RUN_LEDGER = (
    "run_id string, at bigint, recorded_at timestamp, step_name string, input_count bigint, output_count bigint, "
    "criteria string, details map<string,string>"
)


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a fresh local one only under a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="evidrank-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared scratch folder and read them back.

    Cuts the lineage like a reliable checkpoint, but in columnar form: later scans prune columns, and the optimizer
    sees the real size. Survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/evidrank-cuts/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Cut a frame that is about to be read several times; a caller that knows it for a plain scan need not call this."""
    return cut(df)


def drop_cuts(spark: SparkSession) -> None:
    """Delete the cuts this application wrote."""
    _delete(spark, f"{scratch_folder(spark)}/evidrank-cuts/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Ledger:
    """Append-only rows in a folder of any Hadoop file system, a small JSON file each; no Spark job reads or writes it.

    A row is written under a temporary name and renamed, so it is there whole or not at all. Rows are few: one per
    table, batch or step. What others append becomes visible with ``refresh``.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, StructType.fromDDL(schema)
        self._rows: dict[str, dict] | None = None

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def append(self, row: dict) -> None:
        files, name = self._files(), f"{row['at']:020d}-{uuid.uuid4().hex}"
        out = files.create(self._path(f"_{name}"))
        out.write(bytearray(json.dumps(row, default=str).encode()))
        out.close()
        if not files.rename(self._path(f"_{name}"), self._path(f"{name}.json")):
            raise OSError(f"cannot append to the ledger {self.folder}")
        self.rows()
        self._rows[f"{name}.json"] = row

    def refresh(self) -> None:
        """Read the rows that are not known yet."""
        known, self._rows = self._rows or {}, {}
        files = self._files()
        if not files.exists(self._path()):
            return
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        for status in files.listStatus(self._path()):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith("_"):
                if name not in known:
                    stream = files.open(status.getPath())
                    known[name] = json.loads(read.toString(stream, "UTF-8"))
                    stream.close()
                self._rows[name] = known[name]

    def rows(self) -> list[dict]:
        """All rows in the order in which they were written."""
        if self._rows is None:
            self.refresh()
        return [self._rows[name] for name in sorted(self._rows)]

    def frame(self, rows: list[dict] | None = None) -> DataFrame:
        def value(row: dict, field) -> object:
            v = row.get(field.name)
            return datetime.fromisoformat(v) if isinstance(v, str) and field.dataType.typeName() == "timestamp" else v

        listed = self.rows() if rows is None else rows
        return self.spark.createDataFrame([tuple(value(r, f) for f in self.schema) for r in listed], self.schema)


class StageStore:
    """Named tables under one root folder.

    Each save goes to a new folder and becomes current by one appended ledger row, so a reader never sees half a
    table and a stage may be rebuilt from itself. Ledgers are append-only; the latest row per name wins. A store knows
    what it wrote itself and what it found at first; ``refresh`` reads what others have written since.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.stages = Ledger(spark, f"{self.root}/_stages", _STAGE_LEDGER)
        self.runs = Ledger(spark, f"{self.root}/_runs", _RUN_LEDGER)

    def refresh(self) -> None:
        self.stages.refresh()
        self.runs.refresh()

    # -- ledgers ---------------------------------------------------------------------------------------------------

    def _now(self) -> dict:
        return {"at": time.time_ns(), "created_at": datetime.now(timezone.utc).replace(tzinfo=None).isoformat()}

    def _record(self, name: str, **fields) -> None:
        plain = {"row_count": 0, "rows_written": 0, "description": "", "path": None, "replaces": True, "deleted": False}
        self.stages.append({"table_name": name, **self._now(), **plain, "build": None, "batch": None, "batches": None, "fields": None, **fields})

    def _history(self, name: str) -> tuple[list[dict], dict[int, dict], tuple[str, int] | None]:
        """What makes up a table: its current rows (the last full write and what was appended since), and the committed
        batches of the build under way, with its id and number of batches. Of two commits of one batch the first counts;
        one that comes after its build was completed or given up does not."""
        current: list[dict] = []
        batches: dict[int, dict] = {}
        build, over = None, set()
        for row in self.stages.rows():
            if row["table_name"] != name:
                continue
            if row.get("batch") is not None:
                if row["build"] in over:
                    continue
                if build and row["build"] != build[0]:
                    over.add(row["build"])  # began beside the one under way
                    continue
                build = build or (row["build"], row["batches"])
                batches.setdefault(row["batch"], row)
                if len(batches) < build[1]:
                    continue
                current = [batches[i] for i in sorted(batches)]
            elif row["deleted"] or row["replaces"]:
                current = [] if row["deleted"] else [row]
            else:
                current = [*current, row]
                continue
            if build:
                over.add(build[0])
            batches, build = {}, None
        return current, batches, build

    def rows_of(self, name: str) -> int | None:
        """Rows of the current table, from the ledger."""
        current, *_ = self._history(name)
        return sum(r["rows_written"] for r in current) if current else None

    # -- tables ----------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, name: str, metrics: Mapping[str, Column] | None = None) -> tuple[str, dict]:
        """Write rows to a folder of their own; they are counted, and the metrics taken, during the write."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        seen = Observation(f"rows-{uuid.uuid4().hex}")
        watched = df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[c.alias(m) for m, c in (metrics or {}).items()])
        watched.write.parquet(path)
        return path, dict(seen.get)

    def save_measured(
        self, df: DataFrame, name: str, description: str = "", metrics: Mapping[str, Column] | None = None, replace: bool = True
    ) -> dict:
        """Write a stage (or append to it) in one job; returns the aggregates of ``metrics`` and ``_rows``, the rows written."""
        path, seen = self._write(df, name, metrics)
        before = 0 if replace else self.rows_of(name) or 0
        written = int(seen["_rows"])
        self._record(name, row_count=before + written, rows_written=written, description=description, path=path, replaces=replace, fields=df.schema.json())
        return seen

    def save(self, df: DataFrame, name: str, description: str = "", replace: bool = True) -> int:
        return int(self.save_measured(df, name, description, replace=replace)["_rows"])

    def build_in_batches(
        self, keys: DataFrame, on: str, work: Callable[[DataFrame], DataFrame], name: str, batches: int = 16, description: str = ""
    ) -> DataFrame:
        """Build a stage from ``keys`` in batches that are committed one by one; after a failure only the rest is built.

        A key belongs to the batch that its hash names, whatever the order or partitioning of ``keys``. A batch is
        written to a folder of its own and then counts through one ledger row: work that fails in between is done again
        and counted once, work that is committed is never repeated. The table is there when the last batch is committed;
        until then the former one, if any, stays current. A resumed build keeps the number of batches it began with.
        NULL keys share a batch. ``work`` has to treat each key by itself.
        """
        _, done, under_way = self._history(name)
        build, number = under_way or (uuid.uuid4().hex, batches)
        of = F.pmod(F.xxhash64(F.col(on)), F.lit(number))
        for batch in range(number):
            if batch not in done:
                made = work(keys.where(of == batch))
                path, seen = self._write(made, name)
                n = int(seen["_rows"])
                before = sum(r["rows_written"] for r in done.values())
                self._record(name, row_count=before + n, rows_written=n, description=description, path=path, build=build, batch=batch, batches=number, fields=made.schema.json())
                done[batch] = {"rows_written": n}
        return self.load(name)

    def progress(self, name: str) -> tuple[int, int]:
        """Committed batches of an incomplete build, and their number; (0, 0) if there is none."""
        _, done, under_way = self._history(name)
        return len(done), under_way[1] if under_way else 0

    def load(self, name: str) -> DataFrame | None:
        current, *_ = self._history(name)
        if not current:
            return None
        reader, fields = self.spark.read, {r.get("fields") for r in current}
        if len(fields) == 1 and None not in fields:  # else the files are asked, in a job
            reader = reader.schema(StructType.fromJson(json.loads(fields.pop())))
        return reader.parquet(*[r["path"] for r in current])

    def exists(self, name: str) -> bool:
        return bool(self._history(name)[0])

    def list(self) -> DataFrame:
        """Current stages, newest first."""
        names = dict.fromkeys(r["table_name"] for r in self.stages.rows())
        latest = [rows[-1] for rows in (self._history(n)[0] for n in names) if rows]
        latest = [{**r, "row_count": self.rows_of(r["table_name"])} for r in sorted(latest, key=lambda r: -r["at"])]
        return self.stages.frame(latest).select("table_name", "created_at", "row_count", "rows_written", "description")

    def delete(self, name: str) -> None:
        self._record(name, deleted=True)
        _delete(self.spark, f"{self.root}/{name}")

    def export(self, name: str, path: str) -> None:
        table = self.load(name)
        if table is None:
            raise KeyError(f"no stage named {name}")
        table.write.mode("overwrite").parquet(path)

    def query(self, sql: str, args: Mapping[str, object] | list | None = None) -> DataFrame:
        """Parameterised SQL over the current stages, visible under their names."""
        for name in dict.fromkeys(r["table_name"] for r in self.stages.rows()):
            if self.exists(name):
                self.load(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args) if args else self.spark.sql(sql)

    def stage(self, name: str, build: Callable[[], DataFrame], force: bool = False, description: str = "") -> DataFrame:
        """Reuse a stage when it exists, else (or when forced) build and replace it."""
        if force or not self.exists(name):
            self.save(build(), name, description)
        return self.load(name)

    # -- run ledger ------------------------------------------------------------------------------------------------

    def record_step(
        self,
        run_id: str,
        step_name: str,
        input_count: int | None = None,
        output_count: int | None = None,
        criteria: str = "",
        details: Mapping[str, object] | None = None,
    ) -> None:
        now = self._now()
        text = {k: None if v is None else str(v) for k, v in (details or {}).items()}
        self.runs.append(
            {"run_id": run_id, "at": now["at"], "recorded_at": now["created_at"], "step_name": step_name, "input_count": input_count}
            | {"output_count": output_count, "criteria": criteria, "details": text}
        )

    def steps(self, run_id: str | None = None) -> DataFrame:
        """Recorded steps in the order of recording."""
        return self.runs.frame([r for r in self.runs.rows() if run_id is None or r["run_id"] == run_id])


def resume_remaining(wanted: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Keys still to be processed: the wanted ones minus those a partial stage already holds."""
    return wanted.join(done.select(on), on, "left_anti")


def write_id_list(ids: DataFrame, column: str, path: str) -> None:
    """One identifier per line."""
    ids.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).write.mode("overwrite").text(path)
