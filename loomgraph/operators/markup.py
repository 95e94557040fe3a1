"""Markup as rows: every text with the elements that are open around it, and statements from nested boxes."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: Elements without an end, elements of raw text, and for elements that end where another of a list begins, that list.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style", "textarea", "title")
ENDS_BEFORE = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
#: Elements that an implied end doesn't reach beyond.
WALLS = frozenset(["table", "ul", "ol", "dl", "div", "article", "section", "body", "html"])


def texts_in(source: str | None) -> list[tuple[list[str], list[int], str]]:
    """(open elements from the outside, their numbers in the page, text) of each text that isn't blank, in order. An end closes what
    was opened inside and left open; an end without a start is passed over; what is open at the end of the page stays so."""
    source, stack, out, at, made = source or "", [], [], 0, 0

    def add(text: str) -> None:
        if text := html.unescape(text).strip():
            out.append(([n for n, _ in stack], [k for _, k in stack], text))

    while at < len(source):
        found = _PIECE.search(source, at)
        add(source[at : found.start() if found else len(source)])
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        for k in range(len(stack) - 1, -1, -1):  # elements that end where this one begins
            if name in ENDS_BEFORE.get(stack[k][0], ()):
                del stack[k:]
            elif stack[k][0] in WALLS:
                break
        made += 1
        if name in VOID or found[3].endswith("/"):
            continue
        stack.append((name, made))
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            if name in ("title", "textarea"):
                add(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
            stack.pop()
    return out


def elements(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """``key``, seq, path (open elements, joined by /), parents (their numbers), text; texts of a page are numbered from 0."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("parents", pa.list_(pa.int64())), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            found = [[{"path": "/".join(p), "parents": k, "text": t} for p, k, t in texts_in(x)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], [key, "found"])

    held = pages.select(key, F.col(markup).cast("string").alias(markup))
    rows = held.mapInArrow(run, f"{key} {dict(held.dtypes)[key]}, found array<struct<path:string,parents:array<bigint>,text:string>>")
    return rows.select(key, F.posexplode("found").alias("seq", "e")).select(key, F.col("seq").cast("bigint").alias("seq"), "e.path", "e.parents", "e.text")


def boxes(found: DataFrame, key: str = "page_id") -> DataFrame:
    """``key``, seq, s, r, o: statements about a page's first heading. In a row of a table the first header cell, and among definitions
    the term before, is the relation of what follows; a list item's relation is the text right before its list (or ``item``);
    each text is one object. Pages without a heading have no statements."""
    parts = F.split("path", "/")
    # the number of the innermost open element of a name
    level = lambda n: F.when(F.array_contains(parts, n), F.element_at("parents", (F.size(parts) - F.array_position(F.reverse(parts), n) + 1).cast("int")))
    heading = found.where(F.array_contains(parts, "h1")).groupBy(key).agg(F.min_by("text", "seq").alias("s"))
    placed = found.withColumns({"row": level("tr"), "list": F.coalesce(level("ul"), level("ol")), "terms": level("dl"), "item": level("li")})
    here = Window.partitionBy(key).orderBy("seq")
    is_header, is_term = F.array_contains(parts, "th"), F.array_contains(parts, "dt")
    in_row, in_terms = Window.partitionBy(key, "row").orderBy("seq"), Window.partitionBy(key, "terms").orderBy("seq")
    in_list = Window.partitionBy(key, "list").orderBy("seq")
    outside = F.when(F.col("list").isNull(), F.col("text"))
    told = placed.withColumn("header", F.first(F.when(is_header, F.col("text")), True).over(in_row)).withColumn("term", F.last(F.when(is_term, F.col("text")), True).over(in_terms)).withColumn("lead", F.last(outside, True).over(here)).withColumn("lead", F.first("lead").over(in_list))
    r = F.when(F.col("row").isNotNull() & ~is_header, F.col("header")).when(F.col("terms").isNotNull() & ~is_term, F.col("term")).when(F.col("item").isNotNull() & F.col("row").isNull(), F.coalesce("lead", F.lit("item")))
    return told.withColumn("r", r).where("r is not null").join(heading, key).select(key, "seq", "s", "r", F.col("text").alias("o"))
