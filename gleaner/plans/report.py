"""Reports as JSON, text and HTML from groups and items, streamed to any file system that Spark knows."""

from __future__ import annotations

import contextlib
import html
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import human_bytes
from ..operators.results import report_lines, report_totals

ENDINGS = (".json", ".html", ".txt", ".htm")


def output_path(spark: SparkSession, form: str, output: str, default_folder: str) -> str:
    """Where a report goes: a path with a report's ending is a file; any other, and the default, a folder for latest.<form>."""
    form = form if form in ("json", "html") else "txt"
    dot = output.rsplit("/", 1)[-1].rfind(".")
    if output and dot >= 0 and output.rsplit("/", 1)[-1][dot:].lower() in ENDINGS:
        return output
    folder = (output or default_folder).rstrip("/") or "/"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return f"{folder}/latest.{form}"


def export_path(folder: str, form: str, now: datetime | None = None) -> str:
    """The name of an export of this moment."""
    return f"{folder.rstrip('/')}/report-{(now or datetime.now(UTC)).strftime('%Y%m%d-%H%M%S')}.{form}"


@contextlib.contextmanager
def written(spark: SparkSession, path: str):
    """A function that writes text to a file of any file system; it is sent in pieces."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    held: list[str] = []
    size = 0

    def put(text: str) -> None:
        nonlocal size
        held.append(text)
        size += len(text)
        if size > 1 << 16:
            flush()

    def flush() -> None:
        nonlocal size
        data = "".join(held).encode()
        out.write(bytearray(data))
        held.clear()
        size = 0

    try:
        yield put
        flush()
    finally:
        out.close()


def report_json(groups: DataFrame, items: DataFrame) -> DataFrame:
    """(group_id, file_id, json, …), one row per item with its group's facts; similarities below zero are null."""
    keep = items.join(groups.select("group_id", F.col("recommended_file_id").alias("file_id")), ["group_id", "file_id"], "left_semi").groupBy("group_id").agg(F.min("path").alias("recommended_keep"))
    item = F.struct("file_id", "path", "action", F.when(F.col("similarity") >= 0, F.col("similarity")).alias("similarity"), F.col("quality").alias("quality_score"), "size_bytes")
    head = groups.join(keep, "group_id", "left").select("group_id", "group_type", "confidence", F.coalesce("recommended_keep", F.lit("")).alias("recommended_keep"))
    return items.select("group_id", "file_id", F.to_json(item, {"ignoreNullFields": "false"}).alias("json")).join(head, "group_id")


def write_json(groups: DataFrame, items: DataFrame, path: str, scan: dict | None = None, errors: DataFrame | None = None) -> None:
    """{"scan", "errors", "groups": [{"id", "type", "confidence", "recommended_keep", "items"}]}, item by item."""
    with written(groups.sparkSession, path) as put:
        put('{"scan": ' + json.dumps(scan or {}, default=str) + ', "errors": [')
        for k, r in enumerate(errors.toLocalIterator() if errors is not None else ()):
            put("," * (k > 0) + json.dumps(r.asDict(), default=str, ensure_ascii=False))
        put('], "groups": [')
        now = None
        for r in report_json(groups, items).orderBy("group_id", "file_id").toLocalIterator():
            if r["group_id"] != now:
                put("]}," if now is not None else "")
                head = {"id": r["group_id"], "type": r["group_type"], "confidence": r["confidence"], "recommended_keep": r["recommended_keep"]}
                put(json.dumps(head, ensure_ascii=False)[:-1] + ', "items": [')
                now = r["group_id"]
            else:
                put(",")
            put(r["json"])
        put("]}" * (now is not None) + "]}\n")


def totals(groups: DataFrame, items: DataFrame):
    """One row: groups, keep, cleanup, cleanup_bytes and their text."""
    sums = report_totals(items).withColumn("shown", human_bytes("cleanup_bytes")).first()
    return groups.count(), sums["keep"], sums["cleanup"], sums["cleanup_bytes"], sums["shown"]


def write_text(groups: DataFrame, items: DataFrame, path: str, scan: dict | None = None, errors: DataFrame | None = None) -> None:
    """A text report, line by line, without holding it in memory."""
    rows = report_lines(groups, items).join(groups.select("group_id", "group_type", "confidence"), "group_id").orderBy("group_id", "file_id")
    number, _, _, size, shown = totals(groups, items)
    about, last = scan or {}, None
    with written(groups.sparkSession, path) as put:
        put(f"Scanned {about.get('files_seen', 0)} files ({about.get('files_failed', 0)} failed), {number} duplicate groups, threshold={about.get('threshold', 0):.2f}\n")
        for r in rows.toLocalIterator():
            if r["group_id"] != last:
                put(f"\nGroup #{r['group_id']} {r['group_type']} confidence={r['confidence']:.2f}\n")
                last = r["group_id"]
            put(f"  {r['line']}\n")
        if size > 0:
            put(f"\nCleanup candidate total size: {shown}\n")
        for k, e in enumerate(errors.toLocalIterator() if errors is not None else ()):
            put(("\nErrors:\n" if k == 0 else "") + f"  {e['path']} [{e['stage']}] {e['message']}\n")


def write_html(groups: DataFrame, items: DataFrame, path: str, scan: dict | None = None, errors: DataFrame | None = None) -> None:
    """The same as cards of a page, with the counts of what is kept and cleaned up; all texts are escaped."""
    rows = report_lines(groups, items).join(groups.select("group_id", "group_type", "confidence"), "group_id").orderBy("group_id", "file_id")
    number, keep, cleanup, _, shown = totals(groups, items)
    about, last = scan or {}, None
    with written(groups.sparkSession, path) as put:
        put("<!doctype html><meta charset=utf-8><title>Duplicates</title>")
        put(f"<p>{about.get('files_seen', 0)} files, {about.get('files_failed', 0)} failed, {number} groups, {keep} kept, {cleanup} to clean up ({html.escape(shown)})</p>")
        for r in rows.toLocalIterator():
            if r["group_id"] != last:
                put(f"<h2>{r['group_id']} {html.escape(r['group_type'])} {r['confidence']:.2f}</h2>")
                last = r["group_id"]
            put(f"<p>{html.escape(r['line'])}</p>")
        for e in errors.toLocalIterator() if errors is not None else ():
            put(f"<p class=error>{html.escape(str(e['path']))} [{html.escape(str(e['stage']))}] {html.escape(str(e['message']))}</p>")
