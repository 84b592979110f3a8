"""Parts of profile pages: listing cards, citations, venues, offices, courses, interests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say nothing about which venue it is, at the beginning of its name.
NOISE = ("proceedings", "proc.", "in", "of", "the", "annual", "international", "journal:")
PREPRINTS = {"arxiv": "arXiv", "ssrn": "SSRN"}
#: Headings of a teaching section.
HEADINGS = ("Teaching Interests", "Past Courses", "Current Courses")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def _text(html: Column) -> Column:
    return _squeezed(F.regexp_replace(html, "<[^>]*>", " "))


def citations(pages: DataFrame) -> DataFrame:
    """id, n, title, venue and year of the lines of a publication list (id, text): ``authors. "title", venue, year``.

    The title is what stands in quotes, else the first part that ends in a full stop; the year is the last one named.
    """
    lines = pages.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", _squeezed(F.col("line"))).where(F.length("line") > 0)
    quoted = F.regexp_extract("line", '["“]([^"”]+)["”]', 1)
    plain = F.regexp_extract("line", "^([^.]+)[.]", 1)
    title = F.when(quoted != "", quoted).when(plain != "", plain).otherwise(F.col("line"))
    rest = F.regexp_extract("line", '["“][^"”]+["”],?\\s*(.*)$', 1)
    tail = F.when(quoted != "", rest).otherwise(F.regexp_extract("line", "^[^.]+[.]\\s*(.*)$", 1))
    year = F.try_element_at(F.regexp_extract_all("line", F.lit("\\b((?:19|20)\\d\\d)\\b"), F.lit(1)), F.lit(-1))
    return lines.select("id", "n", F.regexp_replace(F.trim(title), "[,.]+$", "").alias("title"), venue(tail).alias("venue"), year.cast("int").alias("year"))


def _bracketed(s: Column) -> Column:
    """What stands in the first brackets if it has no small letter, else null."""
    inside = F.regexp_extract(s, "[(]([^()]*)[)]", 1)
    return F.when((inside != "") & (F.upper(inside) == inside) & (F.length(inside) <= 10), inside)


def venue(raw: Column) -> Column:
    """A short name of where something came out, and the last year named.

    Servers of preprints go by their own name; else an abbreviation in brackets is the name; else what is left of the first
    part up to a comma once words that only count or announce (:data:`NOISE`, numbers, ordinals) are gone at its beginning.
    """
    s = _squeezed(raw)
    years = F.filter(F.split(s, "[^0-9]+"), lambda w: (F.length(w) == 4) & w.between("1900", "2099"))
    server = F.coalesce(*(F.when(F.contains(F.lower(s), F.lit(k)), v) for k, v in PREPRINTS.items()))
    words = F.split(F.element_at(F.split(s, ","), 1), " ")
    weak = lambda w: F.lower(w).isin(*NOISE) | (F.regexp_replace(F.lower(w), "[0-9]+(st|nd|rd|th)?", "") == "")
    kept = F.aggregate(words, F.lit(""), lambda acc, w: F.when(weak(w) & (acc == ""), acc).otherwise(F.trim(F.concat_ws(" ", acc, w))))
    return F.trim(F.concat_ws(" ", F.coalesce(server, _bracketed(s), F.trim(kept)), F.try_element_at(years, F.lit(-1))))


def office(raw: Column) -> Column:
    """The first word with a digit and the building's abbreviation in brackets, where there are both; else the words as they are."""
    s = _squeezed(raw)
    room = F.try_element_at(F.filter(F.split(s, " "), lambda w: F.translate(w, "0123456789", "") != w), F.lit(1))
    return F.when(_bracketed(s).isNotNull() & room.isNotNull(), F.concat_ws(" ", room, _bracketed(s))).otherwise(s)


def courses(rows: DataFrame) -> DataFrame:
    """id, title, codes of taught courses (id, text): ``CS 101 title; CS 610 other title``.

    One line a title, codes in order of their number; a code that stands under several titles goes to the first one.
    """
    items = rows.select("id", F.posexplode(F.split("text", ";")).alias("n", "item")).withColumn("item", _squeezed(F.col("item")))
    code = F.concat_ws(" ", F.regexp_extract("item", "^([A-Z]{2,4})\\s?(\\d{3})\\b", 1), F.regexp_extract("item", "^([A-Z]{2,4})\\s?(\\d{3})\\b", 2))
    pairs = items.where(F.rlike("item", F.lit("^[A-Z]{2,4}\\s?\\d{3}\\b"))).select("id", "n", code.alias("code"), F.lower(F.trim(F.regexp_replace("item", "^[A-Z]{2,4}\\s?\\d{3}\\b[: -]*", ""))).alias("title"))
    once = pairs.withColumn("r", F.row_number().over(Window.partitionBy("id", "code").orderBy("n"))).where("r = 1")
    codes = F.transform(F.array_sort(F.collect_list(F.struct(F.regexp_extract("code", "(\\d+)$", 1).cast("int").alias("number"), "code"))), lambda x: x["code"])
    return once.groupBy("id", "title").agg(F.array_join(codes, ", ").alias("codes"))


def section(raw: Column, heading: str) -> Column:
    """What follows a heading, up to the next of :data:`HEADINGS`; null without the heading."""
    low = F.lower(raw)
    begin = F.instr(low, heading.lower())
    rest = F.when(begin > 0, raw.substr(begin + len(heading), F.length(raw)))
    ends = [F.nullif(F.instr(F.lower(rest), h.lower()), F.lit(0)) for h in HEADINGS if h != heading]
    return F.when(F.coalesce(*ends).isNull(), rest).otherwise(rest.substr(F.lit(1), F.least(*ends) - 1))


def interests(raw: Column) -> Column:
    """The entries of the section on teaching interests; none without it."""
    return F.filter(F.transform(F.split(F.coalesce(section(raw, "Teaching Interests"), F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def listing(pages: DataFrame, card: str = '<a [^>]*href="[^"]*/profile/[^"]*"[^>]*>.*?</a>') -> DataFrame:
    """page_id, n, slug, name, title, section: person cards of a listing page (page_id, html), with the nearest heading before each."""
    piece = F.regexp_extract_all("html", F.lit(f"(?is)({card}|<h[2-4][^>]*>.*?</h[2-4]>)"), F.lit(1))
    parts = pages.select("page_id", F.posexplode(piece).alias("n", "part"))
    heading = F.rlike("part", F.lit("(?i)^<h[2-4]"))
    before = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("section", F.last(F.when(heading, _text(F.col("part"))), ignorenulls=True).over(before)).where(~heading)
    slug = F.regexp_replace(F.regexp_extract("part", '(?i)href="[^"]*/profile/([^"?#]*)', 1), "/+$", "")
    inner = lambda tag: _text(F.regexp_extract("part", f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    name = F.when(inner("h1") != "", inner("h1")).otherwise(_text(F.col("part")))
    return placed.select("page_id", "n", slug.alias("slug"), name.alias("name"), inner("p").alias("title"), F.coalesce("section", F.lit("")).alias("section"))


def hub_links(pages: DataFrame) -> DataFrame:
    """page_id, label, url: the distinct ``<label> Learn more`` links of a hub page (page_id, html)."""
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)(<a\\b[^>]*>.*?</a>)"), F.lit(1))).alias("a"))
    told = links.select("page_id", _text(F.col("a")).alias("t"), F.regexp_extract("a", "(?i)href=\"([^\"]*)\"", 1).alias("url")).where(F.rlike("t", F.lit("(?i)learn more")))
    return told.select("page_id", F.trim(F.regexp_replace("t", "(?i)\\s*learn more\\s*$", "")).alias("label"), "url").where("label <> ''").distinct()
