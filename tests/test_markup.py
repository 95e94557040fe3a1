"""Markup as rows against a parser of the standard library, and statements from nested boxes."""

from html.parser import HTMLParser

import pytest

from loomgraph.operators import markup as M
from loomgraph.sources.tables import table

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{a:b}</style><script>if (a<b) x = "</p>";</script></head><body><h1>Alba <b>L</b></h1><!-- no > text -->
<table><tr><th>Title<td>Hand<td>Master<tr><th>House</th><td><a title="a>b">Oakman</a><table><tr><th>Seat</th><td>Rock</td></tr></table></td><td>after</td></tr></table>
<dl><dt>Born<dd>273<dd>Rock<dt>Alias<dd>Imp</dl>Friends:<ul><li>Bronn<li>Pod<ul><li>nested</ul></ul><p>one<p>two<div>three</i></div><br/>tail"""


def test_paths_of_unclosed_and_nested_elements():
    got = [("/".join(p), t) for p, _, t in M.texts_in(PAGE)]
    assert got == [
        ("html/head/title", "T & U"), ("html/body/h1", "Alba"), ("html/body/h1/b", "L"),
        ("html/body/table/tr/th", "Title"), ("html/body/table/tr/td", "Hand"), ("html/body/table/tr/td", "Master"), ("html/body/table/tr/th", "House"),
        ("html/body/table/tr/td/a", "Oakman"), ("html/body/table/tr/td/table/tr/th", "Seat"), ("html/body/table/tr/td/table/tr/td", "Rock"), ("html/body/table/tr/td", "after"),
        ("html/body/dl/dt", "Born"), ("html/body/dl/dd", "273"), ("html/body/dl/dd", "Rock"), ("html/body/dl/dt", "Alias"), ("html/body/dl/dd", "Imp"),
        ("html/body", "Friends:"), ("html/body/ul/li", "Bronn"), ("html/body/ul/li", "Pod"), ("html/body/ul/li/ul/li", "nested"),
        ("html/body/p", "one"), ("html/body/p", "two"), ("html/body/div", "three"), ("html/body", "tail"),
    ]
    for odd in (None, "", "<", "a < b", "<p", "</p>x", "<!-- open", "<b><i>x</b>y"):
        M.texts_in(odd)
    assert M.texts_in("<b><i>x</b>y")[1][0] == [] and M.texts_in("a < b")[0][2] == "a < b"


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open, self.found, self.held = [], [], ""

    def flush(self):
        if self.held.strip():
            self.found.append(("/".join(self.open), self.held.strip()))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag not in M.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not {"script", "style"} & set(self.open):
            self.held += data

    def handle_comment(self, data):
        self.flush()


def test_pages_equal_the_standard_parser(spark):
    """Over all pages whose paragraphs are closed (in the others that parser lets them nest)."""
    pages = table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "html")
    rows = {r.page_id: r.html for r in pages.collect()}
    got: dict = {k: [] for k in rows}
    for r in M.elements(pages).orderBy("page_id", "seq").collect():
        got[r.page_id].append((r.path, r.text))
    compared = 0
    for k, source in rows.items():
        parser = Plain()
        parser.feed(source or "")
        parser.close()
        parser.flush()
        if all(p.split("/").count("p") < 2 for p, _ in parser.found):
            compared += 1
            assert got[k] == parser.found
    assert compared > 5


@pytest.mark.parametrize("parts", [1, 3])
def test_statements_from_boxes(spark, parts):
    pages = spark.createDataFrame([(1, PAGE), (2, "<ul><li>no heading</ul>"), (3, None), (4, "<h1>S</h1><ul><li>x</li></ul>")], "page_id int, html string").repartition(parts)
    got = [(r.page_id, r.s, r.r, r.o) for r in M.boxes(M.elements(pages)).orderBy("page_id", "seq").collect()]
    about = lambda *pairs: [(1, "Alba", r, o) for r, o in pairs]
    assert got == [
        *about(("Title", "Hand"), ("Title", "Master"), ("House", "Oakman"), ("Seat", "Rock"), ("House", "after"), ("Born", "273"), ("Born", "Rock"), ("Alias", "Imp")),
        *about(("Friends:", "Bronn"), ("Friends:", "Pod"), ("Friends:", "nested")), (4, "S", "S", "x"),
    ]
