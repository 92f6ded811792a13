"""Word files, web pages and pipe tables (SRC-05 .. SRC-09, SRC-14)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from quillstone.functions import text as T

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _spaces(text: str) -> str:
    return " ".join(text.split())


def _paragraph_text(node: ElementTree.Element) -> str:
    """Runs, tabs and line breaks of a paragraph, whitespace collapsed."""
    pieces = {W + "tab": "\t", W + "br": "\n"}
    return _spaces("".join((n.text or "") if n.tag == W + "t" else pieces.get(n.tag, "") for n in node.iter()))


def _style(node: ElementTree.Element) -> str:
    style = node.find(f"./{W}pPr/{W}pStyle")
    return style.get(W + "val", "") if style is not None else ""


def _pictures(node: ElementTree.Element) -> str:
    return ",".join(n.get(R + "embed", "") for n in node.iter(A + "blip") if n.get(R + "embed"))


def word_blocks(content: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(kind, style, text, pictures) of the body in order; table rows as cells joined by pipes."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(W + "body")
    for node in body if body is not None else ():
        if node.tag == W + "p":
            text, pictures = _paragraph_text(node), _pictures(node)
            if text or pictures:
                yield "paragraph", _style(node), text, pictures
        elif node.tag == W + "tbl":
            for row in node.iter(W + "tr"):
                cells = [_spaces(" ".join(_paragraph_text(p) for p in cell.iter(W + "p"))) for cell in row.findall(W + "tc")]
                if any(cells):
                    yield "table_row", "", " | ".join(cells), _pictures(row)


BLOCKS = "ordinal bigint, kind string, style string, text string, pictures string"


def read_word(files: DataFrame, key: str = "path", tables: bool = True) -> DataFrame:
    """SRC-05 .. SRC-07: blocks of Word files in document order.

    files(key, content), for example from ``binaryFile``.  One file is parsed
    in one task; ``ordinal`` counts the blocks that are kept.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame[key], frame["content"]):  # the blocks of one file at a time
                kept = [b for b in word_blocks(bytes(content)) if tables or (b[0] == "paragraph" and b[2])]
                rows = [(name, i, *block) for i, block in enumerate(kept)]
                yield pd.DataFrame(rows, columns=[key, "ordinal", "kind", "style", "text", "pictures"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInPandas(parse, f"{key} {kind}, {BLOCKS}")


#: A piece of text made of numbers, units and punctuation only.
NOT_A_LABEL = r"^[{}();,.:#\-\s0-9%pxrem/]+$"
HIDDEN_PARTS = r"(?is)<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)"
#: Character references that are read; others stay as written.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def page_labels(html: Column | str, limit: int = 60, references: tuple[tuple[str, str], ...] = REFERENCES) -> Column:
    """SRC-08: the first ``limit`` distinct visible texts of 2..79 characters, in page order; ``references`` are read."""
    visible = F.regexp_replace(T.text_or_empty(html), HIDDEN_PARTS, "<>")
    pieces = F.split(visible, r"<[^>]*>")

    def read(piece: Column) -> Column:
        for name, character in references:
            piece = F.replace(piece, F.lit(name), F.lit(character))
        return T.collapse_spaces(piece)

    texts = F.filter(F.transform(pieces, read), lambda x: F.length(x).between(2, 79) & ~x.rlike(NOT_A_LABEL))
    return F.slice(F.array_distinct(texts), 1, limit)


def _json_end(text: str, start: int) -> int:
    """Position of the bracket that closes the one at ``start``; quotes and escapes respected."""
    closing = {"{": "}", "[": "]"}[text[start]]
    depth = 0
    for part in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', text[start:], re.S):
        if part.group() == text[start]:
            depth += 1
        elif part.group() == closing:
            depth -= 1
            if depth == 0:
                return start + part.start()
    return -1


@F.pandas_udf(StringType())
def script_constant(html: pd.Series, name: pd.Series) -> pd.Series:
    """SRC-09: the JSON text of ``const NAME = ...`` in a page, null when absent."""

    def find(page: str | None, constant: str) -> str | None:
        marker = re.search(rf"\bconst\s+{re.escape(constant)}\s*=", page or "")
        opening = re.compile(r"[{\[]").search(page, marker.end()) if marker else None
        if opening is None:
            return None
        end = _json_end(page, opening.start())
        return page[opening.start() : end + 1] if end >= 0 else None

    return pd.Series([find(h, n) for h, n in zip(html, name)])


def image_by_alt(html: Column, alt: str) -> Column:
    """SRC-09: the data URI of the image with this alternative text, empty when absent."""
    quoted = "".join("\\" + c if not c.isalnum() and c.isascii() and c != " " else c for c in alt)
    pattern = rf'(?s)<img\b(?=[^>]*\balt="{quoted}")(?=[^>]*\bsrc="(data:image/[^"]+)")[^>]*>'
    return F.regexp_extract(html, pattern, 1)


def image_bytes(data_uri: Column) -> Column:
    """The decoded content of a data URI."""
    return F.unbase64(F.element_at(F.split(data_uri, ","), -1))


def pipe_table(lines: Column, reach: int = 12) -> Column:
    """SRC-14: the first table among the next ``reach`` lines as rows of column -> cell.

    The table starts at the first line with a pipe and ends before the next
    line without one; rows shorter than the header are dropped.
    """
    near = F.slice(lines, 1, reach)
    cells = F.aggregate(
        near,
        F.struct(F.array().cast("array<array<string>>").alias("rows"), F.lit(False).alias("done")),
        lambda acc, line: F.when(
            ~acc["done"] & F.contains(line, F.lit("|")),
            F.struct(
                F.array_append(acc["rows"], F.transform(F.split(line, r"\|"), lambda c: F.trim(c))).alias("rows"),
                F.lit(False).alias("done"),
            ),
        ).otherwise(F.struct(acc["rows"].alias("rows"), (acc["done"] | (F.size(acc["rows"]) > 0)).alias("done"))),
        lambda acc: acc["rows"],
    )
    columns = F.coalesce(F.get(cells, F.lit(0)), F.array().cast("array<string>"))
    body = F.filter(F.slice(cells, 2, reach), lambda r: F.size(r) >= F.size(columns))
    return F.transform(body, lambda r: F.map_from_arrays(columns, F.slice(r, F.lit(1), F.size(columns))))


@F.pandas_udf(BinaryType())
def minimal_word_file(text: pd.Series) -> pd.Series:
    """A Word file with one paragraph per line; the writing side of ``read_word`` for tests."""

    def build(lines: str | None) -> bytes:
        root = ElementTree.Element(W + "document")
        body = ElementTree.SubElement(root, W + "body")
        for line in (lines or "").split("\n"):
            run = ElementTree.SubElement(ElementTree.SubElement(body, W + "p"), W + "r")
            ElementTree.SubElement(run, W + "t").text = "".join(c for c in line if c >= " " or c == "\t")
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as archive:
            archive.writestr("word/document.xml", ElementTree.tostring(root, encoding="utf-8"))
        return buffer.getvalue()

    return text.map(build)
