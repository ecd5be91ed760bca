"""Stored pages, feed documents, search responses and comment threads as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.functions.text import non_empty, text_gate
from hazardlake.session import cut_lineage

ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


CDATA = r"(?s)<!\[CDATA\[(.*?)\]\]>"


def unwrapped(markup: Column) -> Column:
    """CDATA sections as plain markup."""
    return F.regexp_replace(markup, CDATA, "$1")


def plain_text(markup: Column) -> Column:
    """Markup without CDATA marks and tags, basic and numeric entities resolved, trimmed."""
    out = F.regexp_replace(unwrapped(markup), r"<[^>]*>", "")
    for name, char in ENTITIES[:-1]:
        out = F.replace(out, F.lit(name), F.lit(char))
    # A text with a numeric entity is cut before each "&#"; a piece starts with its number.
    pieces = F.split(out, "&#")

    def piece(p: Column) -> Column:
        number = F.regexp_extract(p, r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        code = F.when(F.lower(number).startswith("x"), F.conv(F.substring(number, 2, 8), 16, 10)).otherwise(number).cast("int")
        valid = (number != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(char, F.substring(p, F.length(number) + 2, F.length(p)))).otherwise(F.concat(F.lit("&#"), p))

    numbers = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), piece), ""))
    out = F.when(F.contains(out, F.lit("&#")), numbers).otherwise(out)
    return F.trim(F.replace(out, F.lit("&amp;"), F.lit("&")))


def element(markup: Column, *names: str) -> Column:
    """Text of the first element with any of the names, null when absent."""
    return non_empty(plain_text(F.regexp_extract(markup, element_pattern(names), 0)))


def element_pattern(names: tuple[str, ...]) -> str:
    """An opening tag up to the closing tag of the same name.

    Of an element inside one of the same name the outer ends where the inner does.
    """
    return "(?is)" + "|".join(rf"<{n}(?:\s[^>]*)?>.*?</{n}>" for n in names)


def elements(markup: Column, *names: str) -> Column:
    """Inner markup of the elements with any of the names, in document order."""
    whole = F.regexp_extract_all(markup, F.lit(element_pattern(names)), F.lit(0))
    return F.transform(whole, lambda e: F.regexp_replace(e, r"^<[^>]*>|</[^>]*>$", ""))


def links(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(r'(?i)href="([^"]*)"'), F.lit(1))


def page_summary(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Title, first paragraph and links of each stored page."""
    m = F.col(html)
    return pages.select(key, element(m, "title").alias("title"), element(m, "p").alias("summary"),
                        links(m).alias("links"))


def extract_items(pages: DataFrame, key: str, markup: str, first: int,
                  items: tuple[str, ...] = ("item", "entry")) -> DataFrame:
    """Feed entries as rows, the ``first`` of each document in document order."""
    blocks = F.slice(elements(F.col(markup), *items), 1, first)
    rows = pages.select(key, F.posexplode(blocks).alias("pos", "block"))
    b = F.col("block")
    return rows.select(
        key, "pos",
        F.coalesce(element(b, "title"), element(b, "a"), F.lit("")).alias("title"),
        F.coalesce(element(b, "description", "summary"), F.lit("")).alias("content"),
        F.coalesce(element(b, "link", "guid"), non_empty(F.regexp_extract(b, r'(?i)href="([^"]*)"', 1)),
                   F.lit("")).alias("link"))


def text_blocks(pages: DataFrame, key: str, html: str, names: tuple[str, ...], first: int,
                min_len: int, words: list[str]) -> DataFrame:
    """The ``first`` elements of each page whose text passes the length-and-keyword gate."""
    texts = F.transform(elements(F.col(html), *names), plain_text)
    numbered = F.transform(texts, lambda t, i: F.struct(i.alias("pos"), t.alias("content")))
    passed = F.slice(F.filter(numbered, lambda b: text_gate(b["content"], min_len, words)), 1, first)
    return pages.select(key, F.explode(passed).alias("b")).select(key, "b.pos", "b.content")


def flatten_search(df: DataFrame) -> DataFrame:
    """One row per hit with user and place names from the response's own side lists.

    The side lists travel inside the response, so no join is needed; the last entry of a
    repeated id wins. Hits and side entries become rows of one shape with the kind of their
    key, and each hit takes the entry of its key: the work grows with hits plus entries of a
    response, not with their product, and the rows of a response are dealt by key. Responses
    are written once with a number, so that a lost task gives the same numbers again.
    """
    whole = cut_lineage(df.select("data", "includes").withColumn("__r", F.monotonically_increasing_id()), "responses")
    hits = whole.select("__r", F.posexplode("data").alias("__i", "t")).select(
        "__r", F.col("t.id").alias("id"), F.col("t.created_at").alias("datetime"), F.col("t.author_id").alias("__user"),
        F.col("t.text").alias("content"), F.col("t.geo.place_id").alias("__place"), F.coalesce("t.lang", F.lit("unknown")).alias("lang"))

    def side(name: str, field: str, key: str, out: str) -> DataFrame:
        entries = whole.select("__r", F.posexplode(f"includes.{name}").alias("__i", "e")).filter("e.id is not null")
        return entries.groupBy("__r", F.col("e.id").alias(key)).agg(F.max_by(f"e.{field}", "__i").alias(out))

    out = (hits.join(side("users", "username", "__user", "user"), ["__r", "__user"], "left")
           .join(side("places", "name", "__place", "place"), ["__r", "__place"], "left"))
    return out.select("id", "datetime", F.coalesce("user", F.lit("unknown")).alias("user"), "content", "place", "lang")


def flatten_threads(df: DataFrame) -> DataFrame:
    """Top comments and replies as rows; replies carry the id of their parent.

    Input: video, top struct<id, author, text, likes>, replies array of the same struct.
    """
    main = df.select("video", "top.*", F.lit("main_comment").alias("type"),
                     F.lit(None).cast("string").alias("parent_id"),
                     F.lit(None).cast("string").alias("parent_text"))
    reply = df.select("video", F.explode("replies").alias("r"), "top").select(
        "video", "r.*", F.lit("reply").alias("type"), F.col("top.id").cast("string").alias("parent_id"),
        F.when(F.length("top.text") > 100, F.concat(F.substring("top.text", 1, 100), F.lit("...")))
        .otherwise(F.col("top.text")).alias("parent_text"))
    return main.unionByName(reply)
