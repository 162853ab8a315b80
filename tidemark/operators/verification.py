"""Verification of cleaned packages and RTF; shares no code with the cleaners, and reads packages with the standard library."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

# Fixed values, stated again on purpose.
ROOTS = {"docprops/core.xml": "coreProperties", "docprops/app.xml": "Properties", "docprops/custom.xml": "Properties"}
NO_DC = {"creator", "contributor", "publisher", "date", "description", "rights", "source", "coverage", "relation"}
META_KEPT = ("rendition:", "media:", "schema:access", "ibooks:")
RTF_LEFT = r"(?s)(?<!\\)(\\\\)*\{\s*(\\\*\s*)?\\(info|generator|userprops|passwordhash|docvar)(?![A-Za-z])|\\bin-?[0-9]"


def rtf_is_clean(content: Column) -> Column:
    """Starts as RTF and holds neither a metadata group nor binary data."""
    text = F.decode(content, "ISO-8859-1")
    return F.coalesce(F.startswith(text, F.lit("{\\rtf")) & ~text.rlike(RTF_LEFT), F.lit(False))


def _tail(tag: str) -> str:
    return tag.rpartition("}")[2]


def _tree(data: bytes) -> ElementTree.Element:
    if b"<!doctype" in data.lower():
        raise ValueError("document type declaration")
    return ElementTree.fromstring(data)


def _empty(root: ElementTree.Element, name: str) -> bool:
    return _tail(root.tag) == name and not len(root) and not root.attrib and not (root.text or "").strip()


def problem(content: bytes, kind: str, product: str = "tidemark") -> str | None:
    """What is wrong with a cleaned package; None if nothing."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            if archive.comment or any(i.date_time != (1980, 1, 1, 0, 0, 0) or i.extra or i.comment or i.external_attr for i in archive.infolist()):
                return "times, comments or extra fields"
            ends = 0
            for i in archive.infolist():
                if i.header_offset != ends:
                    return "gaps between entries"
                ends += 30 + len(i.orig_filename.encode()) + i.compress_size
            if archive.start_dir != ends or content[-22:-18] != b"PK\5\6":
                return "bytes before or behind the entries"
            if archive.testzip():
                return "checksum"
            names = archive.namelist()
            parts = {n: archive.read(n) for n in names}
        if len({n.lower() for n in names}) < len(names):
            return "repeated names"
        if kind == "ooxml":
            for n in names:
                if n.lower().startswith("docprops/") and (n.lower() not in ROOTS or not _empty(_tree(parts[n]), ROOTS[n.lower()])):
                    return f"{n} holds metadata"
            for r in _tree(parts["_rels/.rels"]):
                target = r.get("Target", "").removeprefix("/").lower()
                known = next((n for n in names if n.lower() == target), None)
                kind_ = r.get("Type", "").lower()
                if known and kind_.endswith("/metadata/thumbnail"):
                    return "thumbnail"
                if known and re.search("/(core|extended|custom)-properties$", kind_) and not _empty(_tree(parts[known]), _tail(_tree(parts[known]).tag)):
                    return f"{known} holds metadata"
        elif kind == "odf":
            if any(n.lower().startswith("thumbnails/") and not n.endswith("/") for n in names):
                return "thumbnail"
            if "meta.xml" in parts:
                root = _tree(parts["meta.xml"])
                if _tail(root.tag) != "document-meta" or any(_tail(a) != "version" for a in root.attrib) or len(root) > 1 or any(len(c) or (c.text or "").strip() for c in root):
                    return "meta.xml holds metadata"
        elif kind == "epub":
            paths = [e.get("full-path", "").removeprefix("/") for e in _tree(parts["META-INF/container.xml"]).iter() if _tail(e.tag) == "rootfile"]
            if not paths:
                return "no package document"
            for path in paths:
                for block in (e for e in _tree(parts[path]).iter() if _tail(e.tag) in ("metadata", "dc-metadata", "x-metadata")):
                    for e in block:
                        name, text, prop = _tail(e.tag), (e.text or "").strip(), e.get("property", "").lower()
                        if name in NO_DC or name == "identifier" and not re.fullmatch(rf"urn:{product}:[0-9a-f]{{32}}", text):
                            return f"{name} left"
                        if name == "meta" and (text != "1980-01-01T00:00:00Z" if prop == "dcterms:modified" else not prop.startswith(META_KEPT) and e.get("name", "").lower() != "cover"):
                            return "meta left"
        else:
            return "unknown kind"
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, NotImplementedError, EOFError, zlib.error, struct.error) as error:
        return f"unreadable: {type(error).__name__}"
    return None


def verified(files: DataFrame, keep: list[str], kind_col: str = "kind", content_col: str = "cleaned") -> DataFrame:
    """keep and problem (null: none) of every cleaned package; no shuffle."""
    ship(files.sparkSession)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [problem(c, k) for k, c in zip(batch.column("kind_").to_pylist(), batch.column("content_").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string())], [*keep, "problem"])

    kinds = "".join(f"{c} {files.schema[c].dataType.simpleString()}, " for c in keep)
    return files.select(*keep, F.col(kind_col).alias("kind_"), F.coalesce(F.col(content_col), F.lit(b"")).alias("content_")).mapInArrow(check, f"{kinds}problem string")
