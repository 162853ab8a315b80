"""The whole path of a file: validate, inspect, clean, verify, inspect again, compare, report; no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.formats import browser_kind, extension, refusal_message, validated
from tidemark.functions.rules import failure_message, is_sensitive, key_categories, summary, tokens_categories
from tidemark.operators import containers, inspection, markup, packages, segments, snapshots, streams, verification
from tidemark.operators.segments import FAULTS, Damaged
from tidemark.operators.splice import remembered
from tidemark.session import ship
from tidemark.sources import uploads

RESULT = ["cleaned", "removed", "error_category", "error", "before", "after", "probe_before", "probe_after"]
#: Strategies by kind; a kind without one can't be cleaned and is reported, never copied.
STRATEGIES = (
    dict.fromkeys(segments.READERS, "byte-surgery") | dict.fromkeys(("ooxml", "odf", "epub"), "package-rewrite") | {"svg": "svg-sanitize", "text": "copy", "bmp": "copy"} | containers.STRATEGIES
)


def _fields(content: bytes, kind: str) -> list[dict]:
    """Metadata of a file; a summary that can't be made never blocks cleaning."""
    try:
        return [{"key": k, "value": v} for k, v in inspection.fields_of(content, kind)]
    except FAULTS:
        return []


def clean_one(content: bytes, kind: str | None, plan: dict | None = None) -> tuple[bytes | None, list[str], str | None, str | None]:
    """(bytes, tokens, error category, error) of one file; ``plan`` for the kinds of ``containers``."""
    if kind not in STRATEGIES:
        return None, [], "unsupported", "unsupported_without_tool"
    try:
        if kind in containers.MODULES:
            out, wrong = containers.applied(kind, content, plan)
            return (None, [], "metadata_tool", wrong) if wrong else (out, plan["tokens"], None, None)
        if kind in segments.READERS:
            return *segments.clean_bytes(content, kind), None, None
        if kind == "svg":
            return markup.clean_svg(content), ["svgMetadata"], None, None
        if kind in ("ooxml", "odf", "epub"):
            out, tokens = packages.clean_package(content, kind)
            wrong = verification.problem(out, kind)
            return (None, [], "visual_integrity", wrong) if wrong else (out, tokens, None, None)
        return content, [], None, None
    except FAULTS as error:
        return None, [], "unsafe_svg" if kind == "svg" else "metadata_tool", str(error) if isinstance(error, Damaged) else f"damaged file: {type(error).__name__}"


def checked(files: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """file_id, name, content and error_code (null: accepted): the validation ladder, with limits and parts of packages."""
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), "name", F.coalesce("content", F.lit(b"")).alias("content"))
    rows = rows.withColumn("listing_", remembered(files.sparkSession, "listing", lambda: uploads.listing(F.col("content"))))
    sound = F.col("listing_").isNotNull() & uploads.fault(F.col("listing_")).isNull()
    rows = rows.withColumn("packaged", sound & packages.is_acceptable(extension(F.col("name")), F.col("listing_.entries"))).drop("listing_")
    return validated(rows, caps).select("file_id", "name", "content", "error_code")


def clean(files: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """file_id, name, kind, ok, strategy, cleaned, removed, removed_categories, sensitive (keys found), summary, error_category, error and message.

    files: file_id, name, content; caps: most bytes by category.  Files that the validation ladder refuses have the category
    ``validation`` and are not read further.  Kinds come from names and contents; BMP files are copied, as they hold no metadata.
    """
    ship(files.sparkSession)
    content, ext = F.coalesce(F.col("content"), F.lit(b"")), extension(F.col("name"))
    kind = F.coalesce(F.when((ext == "bmp") & F.startswith(F.col("content"), F.lit(b"BM")), "bmp"), containers.container_kind(F.col("name"), content), browser_kind(F.col("name"), content))
    typed = checked(files, caps).withColumn("kind", kind)
    typed = typed.select("file_id", "name", "kind", F.when(F.col("error_code").isNull(), F.col("content")).otherwise(F.lit(b"")).alias("content"), F.col("error_code").alias("refusal"))
    planned = containers.planned(typed.withColumn("planned_", F.when(F.col("refusal").isNull(), F.col("kind"))), "planned_").drop("planned_", "removed_")
    passed = ["file_id", "name", "kind", *(f"{m}_nodes" for m in containers.MODULES)]
    fields = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.list_(pa.string()), pa.string(), pa.string(), fields, fields, streams._PROBE, streams._PROBE)
        for batch in batches:
            plans = {m: batch.column(f"{m}_plan").to_pylist() for m in containers.MODULES}
            given = zip(batch.column("kind").to_pylist(), batch.column("content").to_pylist(), batch.column("refusal").to_pylist(), batch.column("fault_").to_pylist())
            out = []
            for row, (k, c, refused, fault) in enumerate(given):
                if refused or fault:
                    out.append((None, [], *(("validation", refused) if refused else ("metadata_tool", fault)), [], [], None, None))
                    continue
                cleaned, *rest = clean_one(c, k, plans[k][row] if k in plans else None)
                read = (_fields(c, k), _fields(cleaned, k)) if cleaned is not None else (_fields(c, k), [])
                out.append((cleaned, *rest, *read, streams.probe_of(c, k), streams.probe_of(cleaned, k)))
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *(pa.array(c, t) for c, t in zip(columns, kinds))], [*passed, *RESULT])

    schema = ", ".join(f"{c} {planned.schema[c].dataType.simpleString()}" for c in passed)
    given = "array<struct<key:string,value:string>>"
    rows = planned.mapInArrow(work, f"{schema}, cleaned binary, removed array<string>, error_category string, error string, before {given}, after {given}, probe_before {streams.PROBE}, probe_after {streams.PROBE}")
    rows = containers.judged(rows)
    # Both metadata maps and both probes of a file stand in its row.
    wrong = F.coalesce(
        "problem_",
        remembered(files.sparkSession, "snapshots", lambda: snapshots.map_error(snapshots.as_map(F.col("before")), snapshots.as_map(F.col("after")))),
        remembered(files.sparkSession, "streams", lambda: F.when(F.col("probe_before").isNotNull(), snapshots.streams_error(F.col("probe_before"), F.col("probe_after"), streams.FIELDS))),
    )
    rows = rows.withColumn("wrong", F.when(F.col("error").isNull(), wrong)).withColumn("keys", F.transform("before", lambda f: f["key"]))
    rows = rows.withColumns({"error": F.coalesce("error", "wrong"), "error_category": F.coalesce("error_category", F.when(F.col("wrong").isNotNull(), "visual_integrity"))})
    rows = rows.withColumns({"cleaned": F.when(F.col("error").isNull(), F.col("cleaned")), "removed": F.when(F.col("error").isNull(), F.col("removed")).otherwise(F.array().cast("array<string>"))})
    table = F.create_map(*(F.lit(x) for pair in STRATEGIES.items() for x in pair))
    sensitive = F.array_sort(F.array_distinct(F.transform(F.filter("before", lambda f: is_sensitive(f["key"], f["value"])), lambda f: f["key"])))
    ok, categories = F.col("error").isNull(), tokens_categories(F.col("removed"))
    return rows.select(
        "file_id", "name", "kind", ok.alias("ok"), F.when(ok, table[F.col("kind")]).alias("strategy"), "cleaned", "removed", categories.alias("removed_categories"), key_categories(F.col("keys")).alias("found_categories"), sensitive.alias("sensitive"),
        F.when(ok, summary(F.size("removed"), categories)).alias("summary"), "error_category", "error", F.when(~ok, F.when(F.col("error_category") == "validation", refusal_message(F.col("error"))).otherwise(failure_message(F.col("error_category")))).alias("message"),
    )
