"""Text functions as column expressions (no Python in the row path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that a query may drop, by language; a parameter of every caller.
STOP_WORDS = {
    "en": "the a an of in on and or to is are was for with by".split(),
    "de": "der die das den dem des ein eine und oder in im zu von mit".split(),
    "fr": "le la les un une des de du et ou dans en pour par sur".split(),
    "es": "el la los las un una de del y o en para por con".split(),
    "it": "il lo la i gli le un una di del e o in per con".split(),
}
#: Articles that a title may begin with.
ARTICLES = "the a an der die das ein eine le la les un une el los las".split()
#: Words of section titles.
FRONT = ["preface", "foreword", "acknowledgements", "contents", "table of contents", "dedication", "vorwort", "inhalt", "inhaltsverzeichnis", "widmung"]
BACK = ["bibliography", "references", "index", "notes", "appendix", "glossary", "literaturverzeichnis", "register", "anhang", "anmerkungen"]
TOC_WORDS = ["chapter", "contents", "toc", "part", "kapitel", "inhalt", "teil"]
SENTENCE_END = [".", "!", "?", "…", '"', "”", "»", ")", ":", "。", "！", "？", "”"]


def words(c: Column) -> Column:
    """Parts between white space."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def escape(word: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#" else c for c in word)


def has_keyword(c: Column, keywords: Sequence[str]) -> Column:
    """Whether any keyword stands in the text as a whole word or phrase."""
    if not keywords:
        return F.lit(False)
    alt = "|".join(escape(k.lower()) for k in keywords)
    return F.coalesce(F.lower(c), F.lit("")).rlike(rf"(?U)(?<!\w)(?:{alt})(?!\w)")


def keyword_matches(c: Column, keywords: Sequence[str]) -> Column:
    """How many distinct keywords stand in the text as whole words."""
    n = F.lit(0)
    for k in dict.fromkeys(keywords):
        n = n + has_keyword(c, [k]).cast("int")
    return n


def drop_stop_words(query: str, languages: Sequence[str] | None = None) -> str:
    """The query without function words; as it was if nothing would be left."""
    stop = {w for k in (languages or STOP_WORDS) for w in STOP_WORDS.get(k, [])}
    kept = [w for w in query.split() if w.strip(".,;:!?\"'()[]{}").lower() not in stop]
    return " ".join(kept) if kept else query


def stop_word_free(c: Column, languages: Sequence[str] | None = None) -> Column:
    """The same for a column of queries."""
    stop = sorted({w for k in (languages or STOP_WORDS) for w in STOP_WORDS.get(k, [])})
    bare = lambda w: F.lower(F.regexp_replace(w, r"""^[.,;:!?"'()\[\]{}]+|[.,;:!?"'()\[\]{}]+$""", ""))
    kept = F.filter(words(c), lambda w: ~bare(w).isin(stop))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(c)


def normal_title(c: Column) -> Column:
    """A title for comparing: lower case, no leading articles, no signs."""
    t = F.trim(F.lower(c))
    for a in ARTICLES:
        t = F.regexp_replace(t, rf"^{a}\s+", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


#: Letters that lose their marks, and what they become.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorsstuuuzzz"


def normal_text(c: Column) -> Column:
    """Text for matching: lower case, no accents, signs to blanks."""
    t = F.translate(F.lower(F.trim(c)), MARKED, PLAIN)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def strip_tags(c: Column) -> Column:
    """Markup off by pattern, six entities resolved, white space collapsed."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def year_of(c: Column) -> Column:
    """The first four-digit number that stands alone."""
    y = F.regexp_extract(c, r"\b(\d{4})\b", 1)
    return F.when(y != "", y.cast("int"))


def slug(c: Column, most: int = 60) -> Column:
    t = F.lower(c)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"[^a-z0-9]+", "-")
    t = F.regexp_replace(t, r"^-+|-+$", "")
    return F.regexp_replace(F.substring(t, 1, most), r"-+$", "")


def safe_name(c: Column) -> Column:
    """A file name; where signs had to go, a piece of the hash keeps it unique."""
    t = F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")
    return F.when(t == c, c).otherwise(F.concat(t, F.lit("_"), F.substring(F.md5(c), 1, 8)))


def json_string(c: Column) -> Column:
    """A JSON string literal as Python writes it without ASCII escapes."""
    t = F.coalesce(c, F.lit(""))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), t, F.lit('"'))


def metadata_hash(title: Column, author: Column, publisher: Column, comments: Column, tags: Column) -> Column:
    """MD5 over the record's JSON with sorted keys and sorted tags."""
    t = F.array_join(F.transform(F.sort_array(F.coalesce(tags, F.array())), json_string), ", ")
    return F.md5(
        F.concat(
            F.lit('{"author": '), json_string(author), F.lit(', "comments": '), json_string(comments), F.lit(', "publisher": '), json_string(publisher),
            F.lit(', "tags": ['), t, F.lit('], "title": '), json_string(title), F.lit("}"),
        )
    )


def annotation_hash(highlight: Column, note: Column, kind: Column) -> Column:
    """Aggregate: MD5 over a book's annotations in sorted order, '' when none."""
    line = F.concat_ws("|", F.coalesce(highlight, F.lit("")), F.coalesce(note, F.lit("")), F.coalesce(kind, F.lit("")))
    return F.when(F.count(line) == 0, "").otherwise(F.md5(F.array_join(F.sort_array(F.collect_list(line)), "\n")))


def roman(c: Column) -> Column:
    """The value of a roman numeral, null for anything else."""
    low = F.lower(F.trim(c))
    ok = low.rlike("^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (low != "")
    val = lambda ch: F.element_at(F.create_map(*[F.lit(x) for p in zip("mdclxvi", (1000, 500, 100, 50, 10, 5, 1)) for x in p]), ch)
    chars = F.transform(F.regexp_extract_all(low, F.lit("."), F.lit(0)), val)
    step = lambda acc, v: F.struct((acc["sum"] + v - F.when(acc["last"] < v, acc["last"] * 2).otherwise(0)).alias("sum"), v.alias("last"))
    return F.when(ok, F.aggregate(chars, F.struct(F.lit(0).alias("sum"), F.lit(9999).alias("last")), step, lambda a: a["sum"]))


def section_type(title: Column, front_first: bool = False) -> Column:
    """front_matter, back_matter or main_content by words of the title."""
    f, b = has_keyword(title, FRONT), has_keyword(title, BACK)
    if front_first:
        return F.when(f, "front_matter").when(b, "back_matter").otherwise("main_content")
    return F.when(b, "back_matter").when(f, "front_matter").otherwise("main_content")


def section_number(title: Column) -> Column:
    n = F.regexp_extract(title, r"^(\d+(?:\.\d+)*)[.\s]", 1)
    m = F.regexp_extract(title, r"(?i)^(?:chapter|section|kapitel|abschnitt)\s+(\d+)", 1)
    return F.when(n != "", n).when(m != "", m)


def truncated(c: Column) -> Column:
    """The text ends in the middle of a sentence."""
    last = F.substring(F.rtrim(c), -1, 1)
    return (last != "") & ~last.isin(SENTENCE_END)


def window_text(full: Column, start: Column, end: Column, around: int = 500) -> Column:
    """A stretch with its surroundings."""
    lo = F.greatest(start - around, F.lit(0))
    return F.substring(full, lo + 1, end + around - lo)


def wikilinks(c: Column) -> Column:
    """Link targets, each once in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[\[([^\]\|#]+)"), F.lit(1)), lambda x: F.trim(x)))


def inline_tags(c: Column) -> Column:
    """#tags that do not begin a line."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<=[^\S\n])#([\p{L}\p{N}_/-]+)"), F.lit(1)))


def stable_id(path: Column) -> Column:
    return F.concat(F.lit("folder:"), F.substring(F.sha2(path, 256), 1, 12))
