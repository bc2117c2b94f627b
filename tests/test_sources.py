"""Readers on small files."""

import json
import sqlite3
import zipfile

from pyspark.sql import functions as F

from lectern.sources import databases as D
from lectern.sources import documents as T
from lectern.sources import exports as X
from lectern.sources import folders as L
from lectern.sources import registry as R


def test_folder_and_vault(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / ".obsidian" / "x.md").write_text("no")
    (tmp_path / "sub" / "2024-01-02_chat_old-maps.txt").write_bytes("Gr\xfc\xdfe\r\nda".encode("latin-1"))
    (tmp_path / "7_kant-i_pure-reason.md").write_text("---\ntitle: The Reason\ntags: [a, b]\nLast Read: 2020\n---\n# H\n\nFirst words #topic here [[Other|o]] and [[Third]].\n", encoding="utf-8")
    (tmp_path / "7_kant-i_pure-reason.meta.json").write_text(json.dumps({"author": "Kant, I."}))
    rows = {r["stem"]: r for r in L.documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"2024-01-02_chat_old-maps", "7_kant-i_pure-reason"}
    assert rows["2024-01-02_chat_old-maps"]["text"] == "Grüße\nda" and str(rows["2024-01-02_chat_old-maps"]["day"]) == "2024-01-02"
    assert rows["7_kant-i_pure-reason"]["author"] == "Kant, I."
    n = L.notes(spark, str(tmp_path)).first()
    assert n["title"] == "The Reason" and n["tags"] == ["a", "b", "topic"] and n["links"] == ["Other", "Third"] and n["comment"].startswith("First words")
    assert R.source_kind(spark, str(tmp_path)) == "vault"
    assert L.changed_since(L.documents(spark, str(tmp_path)), "2100-01-01").count() == 0
    assert L.changed_since(L.documents(spark, str(tmp_path)), "nonsense").count() == 2


def test_sqlite_source(spark, tmp_path):
    p = str(tmp_path / "metadata.db")
    with sqlite3.connect(p) as c:
        c.execute("create table books (id integer primary key, title text, rating real)")
        c.executemany("insert into books values (?, ?, ?)", [(i, f"t{i}", None if i % 2 else i / 2) for i in range(1, 60_001)])
        c.execute("create table none_here (id integer, v text)")
    d = D.read_table(spark, p, "books")
    assert d.count() == 60_000 and d.filter("rating is null").count() == 30_000 and dict(d.dtypes)["id"] == "bigint"
    assert D.read_table(spark, p, "none_here").count() == 0


def test_eav(spark):
    v = spark.createDataFrame([(1, "title", "A"), (1, "date", "2000"), (2, "title", "B"), (2, "other", "x")], "item int, field string, value string")
    assert {r["item"]: (r["title"], r["date"]) for r in D.fields(v, ["title", "date"]).collect()} == {1: ("A", "2000"), 2: ("B", None)}
    c = spark.createDataFrame([(1, 1, "Z", "author"), (1, 0, "Y", "author"), (1, 2, "E", "editor"), (2, 0, "F", "editor")], "item int, position int, name string, kind string")
    assert {r["item"]: r["creators"] for r in D.creators(c).collect()} == {1: ["Y", "Z"], 2: ["F"]}
    t = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", None), ("r", "s"), ("s", "r")], "id string, parent string")
    assert sorted(r[0] for r in D.descendants(t, "a").collect()) == ["a", "b", "c"]
    assert sorted(r[0] for r in D.descendants(t, "r").collect()) == ["r", "s"]


CLIPPINGS = """Old Maps (Ann Lee)
- Your Highlight on Location 234-240 | Added on Monday, March 16, 2026 10:23:45 AM

The map is old.
==========
Alte Karten (Jo Ott)
- Ihre Markierung bei Position 12-14 | Hinzugefügt am Montag, 16. März 2026 10:23:45

Die Karte ist alt.
==========
"""


def test_clippings(spark):
    got = X.clippings(spark.createDataFrame([(CLIPPINGS,)], "text string")).orderBy("title").collect()
    assert [(r["title"], r["author"], r["kind"], r["location"], str(r["created_at"]), r["highlight"]) for r in got] == [
        ("Alte Karten", "Jo Ott", "highlight", 12, "2026-03-16 10:23:45", "Die Karte ist alt."),
        ("Old Maps", "Ann Lee", "highlight", 234, "2026-03-16 10:23:45", "The map is old."),
    ]


def test_chat_layouts(spark):
    flat = spark.createDataFrame([(json.dumps({"title": "t", "messages": [{"role": "Human", "content": "q"}, {"role": "gpt", "content": "a"}, {"role": "x", "content": " "}]}),)], "j string")
    assert [(r["role"], r["text"]) for r in X.chats_flat(flat).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    node = lambda p, c, r=None, t=None: {"parent": p, "children": c, "message": None if r is None else {"author": {"role": r}, "content": {"parts": [t]}}}
    tree = {"title": "t", "mapping": {"0": node(None, ["1"]), "1": node("0", ["2", "3"], "user", "q"), "2": node("1", [], "assistant", "old"), "3": node("1", [], "assistant", "new")}}
    assert [(r["role"], r["text"]) for r in X.chats_tree(spark.createDataFrame([(json.dumps(tree),)], "j string")).orderBy("turn").collect()] == [("user", "q"), ("assistant", "new")]
    s = {"name": "n", "chat_messages": [{"sender": "human", "content": [{"type": "text", "text": "q"}, {"type": "tool", "text": "z"}], "attachments": [{"file_name": "f.txt"}]}, {"sender": "other", "content": [], "attachments": []}]}
    assert [r["text"] for r in X.chats_sender(spark.createDataFrame([(json.dumps(s),)], "j string")).collect()] == ["q\n\n[f.txt]"]


def test_prepared_round_trip_and_truncation(spark, tmp_path):
    d = spark.createDataFrame([("b1", "1", "x"), ("b1", "2", None), ("b2", "3", "y")], "book_id string, id string, text string")
    X.write_prepared(d, str(tmp_path / "p"))
    ok, bad = X.read_prepared(spark, str(tmp_path / "p"))
    assert ok.count() == 3 and bad.count() == 0
    for f in (tmp_path / "p" / "book_id=b1").glob("*.json"):
        lines = [x for x in f.read_text().splitlines() if '"2"' not in x]
        f.write_text("\n".join(lines) + "\n" if lines else "")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    ok, bad = X.read_prepared(spark, str(tmp_path / "p"))
    assert [r["book_id"] for r in ok.collect()] == ["b2"] and bad.first()["book_id"] == "b1"


def test_a_library_is_prepared_in_few_files(spark, tmp_path):
    rows = [(f"b{k // 3}", str(k), "x") for k in range(600)] + [("", "e1", "y"), ("", "e2", None)]
    d = spark.createDataFrame(rows, "book_id string, id string, text string").repartition(4)
    X.write_prepared(d, str(tmp_path / "p"), buckets=8)
    files = list((tmp_path / "p").rglob("*.json"))
    assert len(files) == 8 and all('"_header":true' in f.read_text().split("\n")[0] for f in files)
    ok, bad = X.read_prepared(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, ok.collect()), key=str) == sorted(rows, key=str) and bad.count() == 0
    f = next(f for f in files if '"id":"22"' in f.read_text())
    f.write_text("".join(x + "\n" for x in f.read_text().splitlines() if '"id":"22"' not in x))
    (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    ok, bad = X.read_prepared(spark, str(tmp_path / "p"))
    assert ok.count() == len(rows) - 3 and [r["book_id"] for r in bad.collect()] == ["b7"]
    X.write_prepared(d.filter("book_id in ('b1', 'b2')"), str(tmp_path / "q"))
    assert [len(list(x.glob("*.json"))) for x in sorted((tmp_path / "q").glob("book_id=*"))] == [1, 1]


def test_html_and_epub(spark, tmp_path):
    p = T.parse_html("<title>T</title><nav>no</nav><h2>Head</h2><p>One<p>Two <b>x</b><ul><li>a<li>b</ul><div>loose</div><script>z</script>", True)
    assert p.out == ["## Head", "One", "Two **x**", "- a", "- b", "loose"] and p.title == "T"
    f = tmp_path / "a.epub"
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("o/c.opf", '<package><manifest><item id="i1" href="one.xhtml"/></manifest><spine><itemref idref="i1"/></spine></package>')
        z.writestr("o/one.xhtml", "<html><body><h1>Ch</h1><p>Words.</p></body></html>")
    d = spark.read.format("binaryFile").load(str(f))
    r = d.select(T.epub_text(F.col("content")).alias("e"), R.file_format(F.col("path"), F.col("content")).alias("k")).first()
    assert r["e"][0]["title"] == "Ch" and r["k"] == "epub"
    assert T.epub_parts(b"junk") == []
