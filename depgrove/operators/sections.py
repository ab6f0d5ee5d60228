"""Documents as sections: chunks for the index and the heading tree, by one pass over a document's lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from depgrove.operators.batches import cut

SUMMARY = 200
_CHUNK = re.compile(r"(#{1,6}) (.*)", re.S)
_TREE = re.compile(r"(#{1,6})(?: (.*)|$)", re.S)

CHUNKS = "array<struct<section: long, start_line: long, end_line: long, heading_path: string, content: string>>"
TREE = "array<struct<section: long, parent: long, level: int, heading: string, summary: string, line_start: long, line_end: long>>"


def chunk_rows(text: str) -> list[dict]:
    """Slices of a text at its headings; lines count from 1, the breadcrumb joins the open headings.

    A heading may be indented and may end in ``#``; blank texts have no chunks.
    """
    if not text.strip():
        return []
    lines, open_, path, begin, out = text.split("\n"), [""] * 6, "", 0, []
    count = section = 0

    def cut(end: int) -> None:
        if end > begin:
            out.append({"section": section, "start_line": begin + 1, "end_line": end, "heading_path": path, "content": "\n".join(lines[begin:end])})

    for i, line in enumerate(lines):
        if "#" in line and (m := _CHUNK.fullmatch(line.strip())):
            cut(i)
            level, count = len(m[1]), count + 1
            open_[level - 1 :] = [m[2].rstrip("# ").strip(), *[""] * (6 - level)]
            begin, section, path = i, count, " > ".join(x for x in open_ if x)
    cut(len(lines))
    return out


def _summary(lines: list[str]) -> str:
    return next((t[:SUMMARY] for line in lines if (t := line.strip()) and not t.startswith("#")), "")


def tree_rows(text: str) -> list[dict]:
    """The heading tree of a text: a root, then every heading under the nearest shallower one; lines count from 0.

    The summary is the first line of a section's own text; the root takes the first
    heading where nothing stands before it.
    """
    lines = text.split("\n")
    at = [(i, len(m[1]), (m[2] or "").strip()) for i, line in enumerate(lines) if line.startswith("#") and (m := _TREE.fullmatch(line))]
    first = at[0][0] if at else len(lines)
    root = {"section": 0, "parent": None, "level": 0, "heading": "", "summary": _summary(lines[:first]) or (at[0][2] if at else ""), "line_start": 0, "line_end": len(lines) - 1}
    out, open_ = [root], [(0, 0)]
    for n, (i, level, heading) in enumerate(at, 1):
        end = at[n][0] if n < len(at) else len(lines)
        while len(open_) > 1 and open_[-1][1] >= level:
            open_.pop()
        out.append({"section": n, "parent": open_[-1][0], "level": level, "heading": heading, "summary": _summary(lines[i + 1 : end]), "line_start": i, "line_end": end - 1})
        open_.append((n, level))
    return out


def _per_document(docs: DataFrame, rows_of, kind: str, keys: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text"):
            rows = [rows_of(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(rows, of)], names=[*keys, "rows"])

    given = docs.select(*keys, F.col("text").cast("string").alias("text"))
    schema = ", ".join([*(f"{k} {given.schema[k].dataType.simpleString()}" for k in keys), f"rows {kind}"])
    of = to_arrow_type(_parse_datatype_string(kind))
    return given.mapInArrow(run, schema).select(*keys, F.explode("rows").alias("r")).select(*keys, "r.*")


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, section, start_line, end_line, heading_path, content, chunk_id`` of ``doc_id, text`` documents.

    Section 0 stands before the first heading.  Null and blank texts have no chunks;
    repeated documents repeat theirs.
    """
    out = _per_document(docs, chunk_rows, CHUNKS, ("doc_id",))
    return out.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), "heading_path", F.lit(":L"), F.col("start_line").cast("string")))


def tree(docs: DataFrame) -> DataFrame:
    """``doc_id, section, parent, level, heading, summary, line_start, line_end`` of ``doc_id, text`` documents; a null text is an empty one."""
    return _per_document(docs, tree_rows, TREE, ("doc_id",))
