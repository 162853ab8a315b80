"""Table functions over files for SQL text: they take a table, pass its other columns on, and give errors as rows.

    SELECT name, key, value FROM inspect_metadata(TABLE(SELECT name, kind, content FROM files))
    SELECT name, cleaned, removed, error FROM clean_file(TABLE(SELECT name, kind, content FROM files))
    SELECT name, problem FROM verify_clean(TABLE(SELECT name, kind, cleaned AS content FROM results))

The table needs ``kind string`` and ``content binary``; all its other columns come first in the result, and one whose name a result column has is an error
of analysis.  A null content is an empty file.  Nothing is shuffled.  Kinds whose plans are Column rules over many rows (PDF, ISO media, TIFF, Ogg)
can be inspected here; to clean them takes ``plans.hygiene.clean``, and ``clean_file`` says so in ``error``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidemark.operators import containers, inspection, markup, segments, verification
from tidemark.operators.segments import FAULTS
from tidemark.plans import hygiene
from tidemark.session import ship

NEEDED = {"kind": "string", "content": "binary"}


def _analyzed(given: AnalyzeArgument, **added: DataType) -> AnalyzeResult:
    if not given.isTable:
        raise ValueError("a table is needed: TABLE(SELECT kind, content, ... FROM ...)")
    own = {f.name: f.dataType.simpleString() for f in given.dataType.fields}
    missing = [f"{n} {t}" for n, t in NEEDED.items() if own.get(n) != t]
    if missing:
        raise ValueError(f"the table needs {', '.join(missing)}")
    clash = (set(own) - set(NEEDED)) & set(added)
    if clash:
        raise ValueError(f"columns of both table and result: {', '.join(sorted(clash))}")
    return AnalyzeResult(StructType([*(f for f in given.dataType.fields if f.name not in NEEDED), *(StructField(n, t) for n, t in added.items())]))


def _split(row: Row) -> tuple[tuple, str | None, bytes]:
    values = row.asDict(recursive=False)
    return tuple(v for n, v in values.items() if n not in NEEDED), values["kind"], bytes(values["content"] or b"")


class InspectMetadata:
    """A row for each embedded field, in file order; a file that can't be read gives one row with its error, one without fields none."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(files, pos=IntegerType(), key=StringType(), value=StringType(), error=StringType())

    def eval(self, row: Row) -> Iterator[tuple]:
        passed, kind, content = _split(row)
        try:
            found = inspection.fields_of(content, kind)
        except FAULTS as error:
            yield *passed, 0, None, None, f"{type(error).__name__}: {error}"
            return
        for i, (key, value) in enumerate(found):
            yield *passed, i, key, value, None


class CleanFile:
    """One row a file: cleaned (null if it can't be), removed tokens, error category and error."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(files, cleaned=BinaryType(), removed=ArrayType(StringType()), error_category=StringType(), error=StringType())

    def eval(self, row: Row) -> Iterator[tuple]:
        passed, kind, content = _split(row)
        if kind in containers.MODULES:
            yield *passed, None, [], "unsupported", "planned kinds are cleaned by plans.hygiene.clean"
            return
        cleaned, removed, category, error = hygiene.clean_one(content, kind)
        yield *passed, cleaned, list(removed), category, error


def problem_of(content: bytes, kind: str | None) -> str | None:
    """What is still to clean in a file; None if nothing."""
    try:
        if kind in ("ooxml", "odf", "epub"):
            return verification.problem(content, kind)
        if kind == "svg":
            return markup.output_problem(content.decode())
        if kind in segments.READERS:
            return None if segments.clean_bytes(content, kind)[0] == content else "metadata is left"
        return None if kind in ("text", "bmp") else "not verified here"
    except FAULTS as error:
        return f"damaged: {error}"


class VerifyClean:
    """One row a file with its problem, null if it is clean."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(files, problem=StringType())

    def eval(self, row: Row) -> Iterator[tuple]:
        passed, kind, content = _split(row)
        yield *passed, problem_of(content, kind)


def register(spark: SparkSession) -> list[str]:
    """Register the table functions in this session; returns their names."""
    ship(spark)
    functions = {"inspect_metadata": InspectMetadata, "clean_file": CleanFile, "verify_clean": VerifyClean}
    for name, function in functions.items():
        spark.udtf.register(name, udtf(function, useArrow=True))
    return list(functions)
