"""SVG: the sanitizer, and the check of its output as a Column expression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.packages import elements, parse
from tidemark.operators.segments import FAULTS, _need
from tidemark.session import ship

# Elements and attributes that an SVG must not keep.
BLOCKED = "metadata script foreignobject iframe object embed audio video canvas link rdf:rdf rdf desc title handler".split()
ANIMATIONS = "animate set animatetransform animatemotion animatecolor".split()
URLS = "href xlink:href src poster data formaction".split()
SAFE_PREFIXES = ["xml", "xlink"]
RASTERS = "png jpeg jpg gif webp".split()
STYLE_WORDS = ["@import", "javascript:", "-moz-binding", "<"]
STYLE_CALLS = {"expression": "(", "behavior": ":"}  # a name and what must not follow it
OUTPUT_TAGS = "script metadata foreignobject handler title desc".split()
OUTPUT_MARKS = ["javascript:", "<!doctype", "<!--"]
TARGETS = ["href", "xlink:href", "src", "style", "class"]

CR, CRLF = "\0", "\1"  # stand for line ends of the source until it is written: no parsed text holds them
_BASE64 = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=")


def _local(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, ":"), -1))


def output_facts(text: Column) -> dict[str, Column]:
    """Of a text, tag by tag: is_svg, whether its first tag is an SVG's; unsafe_content, a blocked tag, a handler, a script
    address, a document type or a comment; unsafe_target, an animation of a handler, link or style.  Null of a null text."""
    tags = F.regexp_extract_all(text, F.lit("<[^<>]*>"), F.lit(0))
    first = F.get(tags, F.lit(0))
    low = F.lower(text)

    def tag_name(tag: Column) -> Column:
        return _local(F.regexp_extract(tag, r"^<([^ \t\r\n/<>]*)", 1))

    def handles(tag: Column) -> Column:
        names = F.regexp_extract_all(tag, F.lit(r"[ \t\r\n]([^ \t\r\n=<>/]+)[ \t\r\n]*="), F.lit(1))
        return F.exists(names, lambda n: _local(n).startswith("on"))

    targets = F.regexp_extract_all(low, F.lit(r"attributename[ \t\r\n]*=[ \t\r\n]*[\"']([^\"']*)"), F.lit(1))
    content = F.exists(tags, lambda t: tag_name(t).isin(OUTPUT_TAGS) | handles(t))
    for mark in OUTPUT_MARKS:
        content = content | low.contains(mark)
    facts = {
        "is_svg": F.coalesce(F.ltrim(text).startswith(first) & (tag_name(first) == "svg"), F.lit(False)),
        "unsafe_content": content,
        "unsafe_target": F.exists(targets, lambda t: F.trim(t).isin(TARGETS) | _local(F.trim(t)).isin(TARGETS) | _local(F.trim(t)).startswith("on")),
    }
    return {name: F.when(text.isNotNull(), fact) for name, fact in facts.items()}


def output_problem(text: str) -> str | None:
    """What is still wrong with a cleaned SVG, read again by another parser than the cleaner's; None if nothing."""
    found = [m for m in OUTPUT_MARKS if m in text.lower()]
    names: list[str] = []

    def opened(name: str, attributes: dict[str, str]) -> None:
        names.append(_tail(name))
        if names[-1] in OUTPUT_TAGS:
            found.append(name)
        for key, value in attributes.items():
            target = value.strip().lower() if _tail(key) == "attributename" else ""
            if _tail(key).startswith("on") or {target, _tail(target)} & set(TARGETS) or _tail(target).startswith("on"):
                found.append(key)

    reader = expat.ParserCreate()
    reader.StartElementHandler = opened
    try:
        reader.Parse(text.encode(), True)
    except expat.ExpatError as error:
        return str(error)
    if names[0] != "svg":
        found.append(names[0])
    return ", ".join(found) or None


def url_is_safe(value: str) -> bool:
    """A place in the same document, or a raster image that is all in the value."""
    value = "".join(c for c in value if c > " " and c != "\x7f" and not c.isspace())
    head, comma, body = value.partition(",")
    return value[:1] == "#" or bool(comma and body) and head.lower() in {f"data:image/{r};base64" for r in RASTERS} and _BASE64.issuperset(body)


def style_loads(css: str) -> bool:
    """Whether a style could run or load something: its words, its calls, and where its URLs point."""
    low = css.lower()
    if any(word in low for word in STYLE_WORDS):
        return True
    for name, mark in STYLE_CALLS.items():
        if any(rest.lstrip().startswith(mark) for rest in low.split(name)[1:]):
            return True
    arguments = (rest.lstrip()[1:].lstrip() for rest in low.split("url")[1:] if rest.lstrip().startswith("("))
    return any(not (a[1:] if a[:1] in ("'", '"') else a).startswith("#") for a in arguments)


def _tail(name: str) -> str:
    return name.lower().rpartition(":")[2]


def attribute_stays(name: str, value: str) -> bool:
    """By kind of attribute: foreign names, handlers, links and styles each have their rule; all others stay."""
    low, tail = name.lower(), _tail(name)
    space = tail if low.startswith("xmlns:") else low.partition(":")[0] if ":" in low else SAFE_PREFIXES[0]
    if space not in SAFE_PREFIXES or tail.startswith("on"):
        return False
    if {low, tail} & set(URLS):
        return url_is_safe(value)
    return tail != "style" or bool(value) and not style_loads(value)


def element_stays(element) -> bool:
    tag = _tail(element.tagName)
    if tag in BLOCKED:
        return False
    if tag in ANIMATIONS:
        targets = [v.strip().lower() for n, v in element.attributes.items() if _tail(n) == "attributename"][:1]
        return not any(_tail(t).startswith("on") or {t, _tail(t)} & {*URLS, "style", "class"} for t in targets if t)
    if tag == "style":
        css = "".join(n.data for n in element.childNodes if n.nodeType in (n.TEXT_NODE, n.CDATA_SECTION_NODE))
        return bool(css) and not style_loads(css)
    return True


def _sanitize(root) -> None:
    """First what goes as a whole, from the top; then attributes of what is left."""
    todo, left = [root], []
    while todo:
        element = todo.pop()
        left.append(element)
        for child in list(element.childNodes):
            is_element = child.nodeType == child.ELEMENT_NODE
            if child.nodeType in (child.COMMENT_NODE, child.PROCESSING_INSTRUCTION_NODE) or is_element and not element_stays(child):
                element.removeChild(child)
            elif is_element:
                todo.append(child)
    for element in left:
        for name, value in list(element.attributes.items()):
            if not attribute_stays(name, value):
                element.removeAttribute(name)


def _as_written(content: bytes) -> tuple[list[bool], list[str]]:
    """What parsing makes alike: of each element in order, whether it has an end tag; of each line end in texts, in order, CR, CRLF or a line feed (none at all without a CR)."""
    ended: list[bool] = []
    ends: list[str] = []
    opened: list[int] = []
    last = -1  # the element whose start tag was the last thing read
    reader = expat.ParserCreate()
    reader.buffer_text = b"\r" not in content

    def source(begin: int) -> bytes:
        return content[max(0, begin) : begin + 4].replace(b"\0", b"")  # zeros: of two-byte encodings

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal last
        last = len(ended)
        opened.append(last)
        ended.append(True)

    def end(name: str) -> None:
        nonlocal last
        own = opened.pop()
        ended[own] = own != last or not source(reader.CurrentByteIndex - 4).endswith(b"/>")
        last = -1

    def text(data: str) -> None:
        nonlocal last
        last = -1
        if data == "\n" and not reader.buffer_text:
            here = source(reader.CurrentByteIndex)
            ends.append(CRLF if here.startswith(b"\r\n") else CR if here.startswith(b"\r") else "\n")

    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = start, end, text
    reader.Parse(content, True)
    return ended, ends


def _texts(node) -> Iterator:
    for child in node.childNodes:
        if child.nodeType in (child.TEXT_NODE, child.CDATA_SECTION_NODE):
            yield child
        elif child.nodeType == child.ELEMENT_NODE:
            yield from _texts(child)


def clean_svg(content: bytes) -> bytes:
    """The root element without what could run, load or tell; what stays is written as it was: end tags of empty elements, line ends in texts."""
    _need(not re.search(rb"<!doctype", content, re.IGNORECASE), "document type declarations aren't allowed")
    document = parse(content)
    root = document.documentElement
    _need(_tail(root.tagName) == "svg", "not an SVG")
    ended, ends = _as_written(content)
    for element, has_end in zip(elements(document), ended):
        if has_end:
            element.appendChild(document.createTextNode(""))
    at, lines = 0, []
    for node in _texts(root) if ends else ():
        at, begin = at + node.data.count("\n"), at
        lines.append((node, ends[begin:at]))
    prefix = root.tagName.partition(":")[0] if ":" in root.tagName else None
    namespace = root.namespaceURI
    _sanitize(root)
    if prefix and namespace:
        root.setAttribute(f"xmlns:{prefix}", namespace)
    for node, own in lines:
        node.data = "".join(x for pair in zip(node.data.split("\n"), [*own, ""]) for x in pair)
    # CRs of parsed texts were references.  A CR that has come to stand before a line feed would be one line end with it.
    out = re.sub(f"{CR}+(?=\n)", lambda m: "\n" * len(m[0]), root.toxml().replace("\r", "&#13;"))
    out = out.replace(CR, "\r").replace(CRLF, "\r\n")
    _need(output_problem(out) is None, "the cleaned SVG is still unsafe")
    return out.encode()


def cleaned_svg(files: DataFrame, keep: list[str], content_col: str = "content") -> DataFrame:
    """keep, cleaned (null if refused) and error of every file; no shuffle."""
    ship(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column("content_").to_pylist():
                try:
                    out.append((clean_svg(content), None))
                except FAULTS as error:
                    out.append((None, str(error)))
            columns = list(zip(*out)) or [()] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], [*keep, "cleaned", "error"])

    kinds = "".join(f"{c} {files.schema[c].dataType.simpleString()}, " for c in keep)
    return files.select(*keep, F.coalesce(F.col(content_col), F.lit(b"")).alias("content_")).mapInArrow(work, f"{kinds}cleaned binary, error string")
