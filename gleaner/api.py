"""A store of scan results in a folder: replace, list, detail, decide, prune, export, count and clear.

Every table is a chain of version folders, and a change writes a new version, so a
query that reads the one before is never disturbed and a failed write changes
nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from .operators import results, store
from .operators.ordering import ordered
from .plans import report
from .storage import materialise

TABLES = {
    "groups": "group_id long, group_type string, confidence double, recommended_file_id long, stable_key string, status string, ignored_at timestamp, processed_at timestamp",
    "items": "group_id long, file_id long, path string, action string, similarity double, quality double, size_bytes long, media_type string",
    "manifest": "path string, change string, size_bytes long, mtime_ns long, status string, last_seen timestamp",
    "errors": "error_id long, scan_run_id long, path string, stage string, kind string, message string",
    "runs": "scan_run_id long, input_paths string, config string, started_at timestamp, finished_at timestamp, files_seen long, files_failed long",
    "hashes": "path string, size_bytes long, full_hash string, sampled_hash string, algorithm string",
    "images": "path string, width long, height long, format_name string, phash long",
    "videos": "path string, duration_ms long, width long, height long, bit_rate long, codec string, has_audio boolean",
    "frames": "path string, idx int, ts_ms long, hash long",
    "texts": "path string, name string, length int, features array<long>, profile array<int>, bands array<struct<r0:long,r1:long>>",
    "deletions": "mode string, group_id long, file_id long, path string, ok boolean, message string, at timestamp",
}
#: What is derived of a file's content, and goes when that changes.
DERIVED = ("hashes", "images", "videos", "frames", "texts")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _versions(self, name: str) -> list[int]:
        fs, where = self._files(name)
        if not fs.exists(where):
            return []
        done = []
        for s in fs.listStatus(where):
            p = s.getPath()
            if p.getName().startswith("v") and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")):
                done.append(int(p.getName()[1:]))
        return sorted(done)

    def read(self, name: str) -> DataFrame:
        found = self._versions(name)
        if not found:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/v{found[-1]}")

    def write(self, name: str, df: DataFrame) -> None:
        at = (self._versions(name) or [0])[-1] + 1
        fields = _parse_datatype_string(TABLES[name]).fields
        columns, kinds = [f.name for f in fields], {f.name: f.dataType for f in fields}
        df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns)).write.mode("overwrite").parquet(f"{self.root}/{name}/v{at}")

    def replace(self, groups: DataFrame, items: DataFrame) -> None:
        """Take a scan's result; decisions about groups of equal stable key stay."""
        self.write("groups", store.replace_groups(groups, self.read("groups")))
        self.write("items", items)

    def rescan(self, listing: DataFrame) -> DataFrame:
        """The next manifest from a listing (path, size_bytes, mtime_ns); see its `change`.

        What was derived of files that changed goes from the feature tables; of
        unchanged and missing files it stays, to be loaded again.
        """
        before = self.read("manifest")
        now = store.incremental_status(before, listing).join(before.select("path", "last_seen"), "path", "left")
        self.write("manifest", store.touch(now, listing, F.current_timestamp()))
        manifest = self.read("manifest")
        stale = manifest.where("change IN ('changed', 'added')").select("path")
        for name in DERIVED:
            if self._versions(name):
                self.write(name, self.read(name).join(stale, "path", "left_anti"))
        return manifest

    def save_features(self, name: str, rows: DataFrame) -> None:
        """Replace the rows of these paths in a table of features."""
        if name not in DERIVED or name == "hashes":
            raise ValueError(f"{name!r} is no table of features")
        self.write(name, store.upsert(self.read(name), rows))

    def save_hashes(self, full: DataFrame | None = None, sampled: DataFrame | None = None) -> None:
        """Keep digests (path, size_bytes, digest) of whole contents, of samples, or both."""
        none = self.spark.createDataFrame([], "path string, size_bytes long, digest string")
        self.write("hashes", store.save_hashes(self.read("hashes"), none if full is None else full, none if sampled is None else sampled))

    def load_features(self, name: str) -> DataFrame:
        """Features of the files that are there and unchanged; digests by store.load_hashes()."""
        rows = store.carry_features(self.read(name), self.read("manifest"))
        return store.load_hashes(rows) if name == "hashes" else rows

    def start_run(self, paths: list[str], config: dict | None = None) -> int:
        """Log a run's begin; its id is one more than the last."""
        run = (self.latest_run() or 0) + 1
        row = self.spark.createDataFrame([(run, json.dumps(paths), json.dumps(config or {}, default=str))], "scan_run_id long, input_paths string, config string")
        self._append("runs", row.withColumn("started_at", F.current_timestamp()))
        return run

    def finish_run(self, run: int, files_seen: int, files_failed: int) -> None:
        own = F.col("scan_run_id") == run
        put = lambda c, v: F.when(own, v).otherwise(F.col(c)).alias(c)
        self.write("runs", self.read("runs").select("scan_run_id", "input_paths", "config", "started_at", put("finished_at", F.current_timestamp()), put("files_seen", F.lit(files_seen)), put("files_failed", F.lit(files_failed))))

    def record_errors(self, run: int, errors: DataFrame) -> None:
        """Keep errors (path, stage, kind, message); an empty kind means that the file was skipped."""
        base = self.read("errors").agg(F.max("error_id")).first()[0] or 0
        kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("skipped"))
        numbered = ordered(errors.withColumn("kind", kind), [], [F.col("path"), F.col("stage")])
        self._append("errors", numbered.select((F.col("k") + base).alias("error_id"), F.lit(run).alias("scan_run_id"), "path", "stage", "kind", "message"))

    def load_errors(self, run: int | None = None) -> DataFrame:
        return results.load_errors(self.read("errors"), run)

    def latest_run(self) -> int | None:
        return results.latest_run(self.read("runs")).first()[0]

    def _append(self, name: str, rows: DataFrame) -> None:
        fields = _parse_datatype_string(TABLES[name]).fields
        full = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
        self.write(name, self.read(name).unionByName(full))

    def list_groups(self, **how) -> DataFrame:
        return results.list_groups(self.read("groups"), self.read("items"), **how)

    def get_group(self, group_id: int, facts: DataFrame) -> DataFrame:
        """Members of a group with facts (file_id, width, height, phash)."""
        return results.group_detail(self.read("groups").where(F.col("group_id") == group_id), self.read("items").where(F.col("group_id") == group_id), facts)

    def set_status(self, ids: DataFrame, status: str) -> None:
        self.write("groups", store.set_status(self.read("groups"), ids, status, F.current_timestamp()))

    def set_recommended(self, picks: DataFrame) -> None:
        self._both(*store.set_recommended(self.read("groups"), self.read("items"), picks))

    def delete_paths(self, paths: DataFrame) -> None:
        """Forget files; a request that leaves a group without any file is refused."""
        items = self.read("items")
        if not store.delete_guard(items, items.join(paths.select("path"), "path", "left_semi")).isEmpty():
            raise ValueError("a group would lose all its files")
        self._both(*store.delete_paths(self.read("groups"), items, paths))

    def deleted(self, outcome: DataFrame, alive: DataFrame, mode: str, ids: DataFrame | None = None) -> list[int]:
        """Log a deletion (path, ok, message); the groups that are settled by it, which become processed.

        alive: (path) of files that are still there. See store.delete_effects().
        """
        audit, done = store.delete_effects(self.read("groups"), self.read("items"), outcome, alive, mode, ids)
        self._append("deletions", audit.withColumn("at", F.current_timestamp()))
        settled = materialise(done, "settled")
        self.set_status(settled, "processed")
        return sorted(r["group_id"] for r in settled.toLocalIterator())

    def deletable(self, ids: DataFrame) -> DataFrame:
        """Members of groups without their winners."""
        return store.group_members(self.read("groups"), self.read("items"), ids)

    def _both(self, groups: DataFrame, items: DataFrame) -> None:
        self.write("groups", groups)
        self.write("items", items)

    def summary(self) -> DataFrame:
        return results.summary(self.read("groups"), self.read("items"))

    def info(self) -> dict[str, int]:
        """Rows of each table."""
        return {name: self.read(name).count() for name in TABLES}

    def clear(self) -> None:
        for name in TABLES:
            fs, where = self._files(name)
            fs.delete(where, True)

    def export(self, path: str, form: str | None = None, scope: str = "pending", scan: dict | None = None) -> str:
        """Write a report and return its path; a scope but pending takes all groups.

        The name's ending (json, html or txt) is the report's form; to a folder goes
        a file named by form and time.
        """
        known = path.rsplit(".", 1)[-1].lower()
        known = "html" if known == "htm" else known
        if known not in ("json", "html", "txt"):
            known = form or "json"
            path = report.export_path(path, known)
        groups, items = self.read("groups"), self.read("items")
        groups = groups.where("status = 'pending'") if scope == "pending" else groups
        items = items.join(groups.select("group_id"), "group_id", "left_semi")
        run = self.latest_run()
        errors = self.load_errors(run) if run is not None else None
        {"json": report.write_json, "html": report.write_html, "txt": report.write_text}[known](groups, items, path, scan, errors)
        return path
