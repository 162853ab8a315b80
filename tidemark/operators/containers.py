"""Formats whose cleaning is a plan in Columns: PDF, ISO media, TIFF and Ogg.

Each format's module reads a file into one nested column (``nodes``), decides by Column rules (``plan``, with the tokens of what goes), has a
helper for the bytes (``apply``), and judges the result by reading it again (``problem``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.formats import extension, looks_like_pdf, starts_with
from tidemark.operators import isomedia, ogg, pdf, tiff
from tidemark.operators.segments import Damaged
from tidemark.operators.splice import let, remembered, values
from tidemark.session import ship

MODULES = {"pdf": pdf, "isomedia": isomedia, "tiff": tiff, "ogg": ogg}
PORTION = 8 << 20  # bytes of results after which a batch of rows is passed on
STRATEGIES = {"pdf": "pdf-rewrite", "isomedia": "container-rewrite", "tiff": "directory-rewrite", "ogg": "page-rewrite"}


def container_kind(name: Column, content: Column) -> Column:
    """The module for a file, by extension and first bytes; null if none."""
    ext, first = extension(F.concat(F.lit("x"), name)), F.decode(F.substring(content, 5, 4), "ISO-8859-1")
    return (
        F.when((ext == "pdf") & looks_like_pdf(content), "pdf")
        .when(ext.isin("mp4", "m4v", "mov", "qt", "3gp", "3gpp", "m4a") & first.isin("ftyp", "moov", "mdat", "wide", "free", "skip", "pnot"), "isomedia")
        .when(ext.isin("tif", "tiff") & (starts_with(content, b"II*\0") | starts_with(content, b"MM\0*")), "tiff")
        .when(ext.isin("ogg", "oga", "opus") & starts_with(content, b"OggS"), "ogg")
    )


def planned(files: DataFrame, kind: str = "kind", content: str = "content", modules: dict = MODULES, made: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """``files`` with, for each format, the columns ``<kind>_nodes`` and ``<kind>_plan``, and removed_ (tokens) and fault_ of all.  ``made``: as of ``cleaned``."""
    for name, module in modules.items():
        files = files.withColumn(f"{name}_nodes", module.nodes(F.when(F.col(kind) == name, F.col(content)), made))
    plans = {name: remembered(files.sparkSession, f"plan {name}", lambda n=name, m=module: let(F.col(f"{n}_nodes"), m.plan)) for name, module in modules.items()}
    files = files.withColumns({f"{name}_plan": F.when(F.col(f"{name}_nodes.error").isNull() & (F.col(kind) == name), plan) for name, plan in plans.items()})
    fault = F.coalesce(*(F.col(f"{name}_nodes.error") for name in modules))
    return files.withColumn("removed_", F.coalesce(*(F.col(f"{name}_plan.tokens") for name in modules), F.array().cast("array<string>"))).withColumn("fault_", fault)


def applied(kind: str, content: bytes, plan) -> tuple[bytes | None, str | None]:
    """The file as its plan says, or an error."""
    try:
        return MODULES[kind].apply(content, plan), None
    except (Damaged, TypeError, ValueError, IndexError, OverflowError) as error:
        return None, str(error) if isinstance(error, Damaged) else "damaged file"


def judged(rows: DataFrame, kind: str = "kind", result: str = "cleaned", modules: dict = MODULES) -> DataFrame:
    """``planned`` rows with problem_: what is wrong with their results, read again (now, if ``<kind>_after`` isn't there); null if nothing or if there is none."""
    out, added = F.lit(None).cast("string"), [f"{name}_after" for name in modules if f"{name}_after" not in rows.columns]
    for name, module in modules.items():
        mine = (F.col(kind) == name) & F.col(result).isNotNull()
        if f"{name}_after" in added:
            rows = rows.withColumn(f"{name}_after", module.nodes(F.when(mine, F.col(result))))
        wrong = remembered(rows.sparkSession, f"problem {name} {result}", lambda n=name, m=module: let(F.col(f"{n}_after"), lambda after: m.problem(F.col(f"{n}_nodes"), after, F.col(result))))
        out = F.coalesce(out, F.when(mine, wrong))
    return rows.withColumn("problem_", out).drop(*added)


def cleaned(files: DataFrame, keep: list[str], kind: str | None = None, kind_col: str = "kind", content_col: str = "content", made: Callable[[bytes], bytes] | None = None, again: bool = False) -> DataFrame:
    """keep, cleaned (null if refused), removed (tokens) and error of every file; no shuffle.  ``kind``: of all files, in place of ``kind_col``.

    ``made``: what makes a file's bytes of ``content_col``, always the same of the same; it is called where they are read, one file at a time, so
    that large files needn't pass between Spark and Python in batches.  ``again``, with ``kind``: also ``nodes``, what its reader finds in ``cleaned``.
    """
    ship(files.sparkSession)
    rows = files.select(*keep, (F.lit(kind) if kind else F.col(kind_col)).alias("kind_"), F.coalesce(F.col(content_col), F.lit(b"")).alias("content_"))
    modules = {k: m for k, m in MODULES.items() if kind in (None, k)}
    nodes, after = [f"{name}_nodes" for name in modules], [f"{name}_after" for name in modules]
    passed = [*keep, "kind_", "removed_", *nodes]
    rows = planned(rows, "kind_", "content_", modules, made)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [values(batch.column(c)) for c in ("kind_", "fault_", *(f"{name}_plan" for name in modules))]
            begin, size, out = 0, 0, []
            for end, (b, k, fault, *plans) in enumerate(zip(values(batch.column("content_"), made), *columns), 1):
                plan = plans[list(modules).index(k)] if k in modules else None
                out.append(applied(k, b, plan) if plan is not None and not fault else (None, fault or "unsupported_without_tool"))
                size += len(out[-1][0] or b"")
                if size > PORTION or end == batch.num_rows:
                    (results, errors), part = zip(*out), batch.slice(begin, end - begin)
                    again = [m.read(b if k == name else None for b, k in zip(results, values(part.column("kind_")))) for name, m in modules.items()]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *again, pa.array(results, pa.binary()), pa.array(errors, pa.string())], [*passed, *after, "cleaned", "error"])
                    begin, size, out = end, 0, []

    kinds = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in passed), *(f"{c} {rows.schema[n].dataType.simpleString()}" for c, n in zip(after, nodes))])
    out = judged(rows.mapInArrow(work, f"{kinds}, cleaned binary, error string"), "kind_", modules=modules).withColumn("error", F.coalesce("error", "problem_"))
    fine = F.col("error").isNull()
    return out.select(*keep, F.when(fine, F.col("cleaned")).alias("cleaned"), F.when(fine, F.col("removed_")).otherwise(F.array().cast("array<string>")).alias("removed"), "error", *([F.when(fine, F.col(f"{kind}_after")).alias("nodes")] if again else []))
