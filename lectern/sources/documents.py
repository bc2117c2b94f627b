"""Text of HTML and EPUB documents."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are left out, and those that make a block.
DROPPED = {"script", "style", "nav", "footer", "header"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Blocks(HTMLParser):
    """Text of the outermost blocks, headings with their level."""

    def __init__(self, marks: bool = False):
        super().__init__(convert_charrefs=True)
        self.marks, self.out, self.headings, self.title = marks, [], [], ""
        self.skip = self.depth = 0
        self.tag, self.buf, self.loose, self.in_title = "", [], [], False

    def handle_starttag(self, tag, attrs):
        if self.depth and self.tag == "p" and tag in ("p", "ul", "ol", "div", "table", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"):
            self._close()  # these end an open paragraph
            self.depth = 0
        if tag in DROPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in BLOCKS:
            if self.depth == 0:
                self._loose()
                self.tag, self.buf = tag, []
            elif tag == self.tag == "li" or tag == self.tag == "p":
                self._close()
                self.tag = tag
                self.depth -= 1
            self.depth += 1
        elif tag in ("div", "br", "tr", "table"):
            (self.buf.append("\n") if self.depth else self._loose())
        elif self.marks and tag in MARKS:
            self._text(MARKS[tag])

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in BLOCKS and self.depth:
            self.depth -= 1
            if self.depth == 0:
                self._close()
        elif tag in ("ul", "ol") and self.depth and self.tag == "li":
            self._close()  # ends an open item
            self.depth = 0
        elif tag == "div" and not self.depth:
            self._loose()
        elif self.marks and tag in MARKS:
            self._text(MARKS[tag])

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self._text(data)

    def _text(self, t):
        (self.buf if self.depth else self.loose).append(t)

    def _loose(self):
        t = " ".join("".join(self.loose).split())
        self.loose = []
        if t:
            self.out.append(t)

    def _close(self):
        t = " ".join("".join(self.buf).split())
        self.buf = []
        if not t:
            return
        if self.tag[0] == "h":
            self.headings.append((int(self.tag[1]), t))
            t = "#" * int(self.tag[1]) + " " + t if self.marks else t
        elif self.tag == "li" and self.marks:
            t = "- " + t
        self.out.append(t)

    def finish(self):
        self.close()
        if self.depth:
            self._close()
        self._loose()
        return self


def parse_html(text: str | None, marks: bool = False) -> _Blocks:
    p = _Blocks(marks)
    p.feed(text or "")
    return p.finish()


def html_text(c: Column) -> Column:
    """struct<text, title, headings> of an HTML document."""

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [parse_html(t) for t in s]
        return pd.DataFrame({"text": ["\n\n".join(r.out) for r in rows], "title": [r.title.strip() for r in rows], "headings": [[h for _, h in r.headings] for r in rows]})

    return F.pandas_udf(run, "text string, title string, headings array<string>")(c)


def html_markdown(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: "\n\n".join(parse_html(t, True).out)), "string")(c)


def epub_parts(content: bytes) -> list[tuple[str, str, str]]:
    """(name, title, text) of the readable parts of an EPUB, in spine order."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        opf = next(n for n in z.namelist() if n.endswith(".opf"))
        xml = z.read(opf).decode("utf-8", "replace")
    except (zipfile.BadZipFile, StopIteration, KeyError):
        return []
    items = {}
    for m in re.finditer(r"<item\b[^>]*>", xml):
        a = dict(re.findall(r'([\w:-]+)="([^"]*)"', m[0]))
        items[a.get("id")] = a.get("href", "")
    base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
    out = []
    for ref in re.findall(r'<itemref\b[^>]*idref="([^"]+)"', xml):
        name = base + items.get(ref, "")
        if name in z.namelist():
            p = parse_html(z.read(name).decode("utf-8", "replace"))
            out.append((name, p.headings[0][1] if p.headings else p.title.strip(), "\n\n".join(p.out)))
    return out


def epub_text(content: Column) -> Column:
    """array<struct<name, title, text>> of EPUB bytes; unreadable: empty."""
    schema = "array<struct<name:string,title:string,text:string>>"
    return F.pandas_udf(lambda s: s.map(lambda b: [{"name": n, "title": t, "text": x} for n, t, x in epub_parts(bytes(b))] if b is not None else []), schema)(content)
