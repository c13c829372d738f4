"""Pages as elements against a parser that reads tag by tag."""

import json
import re
from html.parser import HTMLParser

from tidemill.functions import html

from .conftest import SMALL

PAGES = [
    "<h1>A &amp; B</h1><p>one<br>two<p>three <b>bo</b>ld</p>tail<ul><li>x<li>y &lt;z&gt;</ul><h3> Deep\n title </h3>",
    "<p>before</p><table class='t'><tr><th>a</th><th>b&nbsp;</th></tr><tr><td><p>1</p></td><td>2 <i>mm</i></td></tr></table>after",
    "<head><title>no</title></head><script>var x='<p>no</p>'</script><!-- <p>no</p> --><style>p{}</style><DIV>yes</DIV>",
    "plain text &#233; &#x41; &#128512; &#55296; &amp;lt; 3 < 4", "", "<p></p><div> </div>", None, "<p>" + "long " * 50_000 + "</p>", "<ol><li><p>inner</p></li></ol>", "a\x01b\x02\x03c",
    "<table><tr></tr></table>", "<pre>x</pre><blockquote>q</blockquote>",
]


class Reader(HTMLParser):
    """Element by element, by the rule."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.kind, self.level, self.buffer, self.skip, self.grid = [], "paragraph", None, "", 0, None

    def flush(self, kind="paragraph", level=None):
        text = re.sub(r"[ \t\r\n\xa0]+", " ", self.buffer).strip(" ")
        if text:
            self.out.append((self.kind, self.level, text, None))
        self.kind, self.level, self.buffer = kind, level, ""

    def cell(self):
        if self.grid and self.grid[-1]:
            self.grid[-1][-1] = re.sub(r"[ \t\r\n\xa0]+", " ", self.buffer).strip(" ")
        self.buffer = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif tag == "br":
            self.buffer += " "
        elif self.grid is not None:
            if tag == "tr":
                self.cell()
                self.grid.append([])
            elif tag in ("td", "th"):
                self.cell()
                self.grid[-1].append("")
        elif tag == "table":
            self.flush()
            self.grid = []
        elif tag in html.BLOCKS:
            self.flush("heading" if re.fullmatch("h[1-6]", tag) else "list" if tag == "li" else "paragraph", int(tag[1]) if re.fullmatch("h[1-6]", tag) else None)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip -= 1
        elif tag == "table":
            self.cell()
            self.out.append(("table", None, None, [[{"text": c} for c in r] for r in self.grid]))
            self.grid = None
        elif self.grid is None and tag in html.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.buffer += re.sub("[\x01-\x03]", " ", data)

    def handle_entityref(self, name):
        self.handle_data({"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}.get(name, f"&{name};"))

    def handle_charref(self, name):
        n = int(name) if name.isdigit() else 0
        self.handle_data(chr(n) if n and not 0xD800 <= n <= 0xDFFF else f"&#{name};")


def read(page):
    reader = Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return reader.out


def check(rows, df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: r.pos):
        got.setdefault(r.page_id, []).append((r.type, r.level, r.text, json.loads(r.table_json)["grid"] if r.table_json else None))
    want = {i: out for i, p in rows if (out := read(p))}
    assert {i: got.get(i) for i in want} == want and set(got) == set(want)


def test_awkward_pages(spark):
    rows = list(enumerate(PAGES))
    check(rows, html.elements(spark.createDataFrame(rows, "page_id long, html string"), ["page_id"]))


def test_all_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html")
    check([tuple(r) for r in pages.collect()], html.elements(pages, ["page_id"]))
    assert "Exchange" not in html.elements(pages, ["page_id"])._jdf.queryExecution().executedPlan().toString()
