"""Cards of list pages: each listing is an <article> of its own inside a portal's page of results."""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import prices, scoring, text


_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""")
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _elements(page: str, tag: str | None, css_class: str | None, first: bool) -> list[str]:
    """The elements of a page, in order of their opening tags: each ends at its own closing tag, however many of its kind it holds, or at the page's end."""
    found: list[list[int]] = []
    still: dict[str, list[int | None]] = defaultdict(list)  # open elements by tag: the place in found of those asked for
    for m in _TAG.finditer(page):
        name, said = m[2].lower(), m[3]
        if m[1]:
            if still[name] and (place := still[name].pop()) is not None:
                found[place][1] = m.end()
                if first and place == 0:
                    break
            continue
        wanted = (tag is None or name == tag) and (not css_class or ((c := _CLASS.search(said)) is not None and css_class in (c[1] or c[2] or c[3] or "").split()))
        empty = name in _VOID or said.endswith("/")
        if wanted:
            found.append([m.start(), m.end() if empty else len(page)])
        if not empty:
            still[name].append(len(found) - 1 if wanted else None)
        elif wanted and first and len(found) == 1:
            break
    return [page[a:b] for a, b in (found[:1] if first else found)]


def elements(html: Column, tag: str | None = None, css_class: str | None = None, first: bool = False) -> Column:
    """The outer HTML of a page's elements of a tag and a class (nested ones too), or of the first one only; null for a null page."""

    @F.pandas_udf("array<string>")
    def select(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else _elements(p, tag, css_class, first))

    return select(html)


def cards(html: Column, css_class: str | None = None) -> Column:
    """The <article> elements of a page; css_class: only those that have the class."""
    return elements(html, "article", css_class)


def inner_text(html: Column) -> Column:
    """Without tags; white space in one space."""
    return text.strip_ws(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def by_class(card: Column, css_class: str) -> Column:
    """The text of the first element of a class, null if there is none."""
    return inner_text(F.get(elements(card, None, css_class, True), F.lit(0)))


def by_tag(card: Column, tag: str) -> Column:
    return inner_text(F.get(elements(card, tag, None, True), F.lit(0)))


def attribute(card: Column, tag: str, name: str) -> Column:
    """An attribute of the first element of a tag, null if it has none."""
    pattern = rf"""<{tag}\b[^>]*?\b{name}\s*=\s*("[^"]*"|'[^']*')"""
    return F.when(card.rlike(pattern), F.regexp_replace(F.regexp_extract(card, pattern, 1), "^.|.$", ""))


def _on(base: str, href: Column) -> Column:
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href)


def list_items(pages: DataFrame, html: str, base: str, city: Column) -> DataFrame:
    """Listings of pages whose items have classes; those without a title, a price or a size are left out."""
    held = pages.select(F.explode(cards(F.col(html), "item")).alias("card"), city.alias("city_raw"))
    read = held.select("*", by_class(F.col("card"), "item-link").alias("title"), prices.parse_price_digits(by_class(F.col("card"), "item-price")).alias("price"), F.concat(F.lit(base), attribute(F.col("card"), "a", "href")).alias("url"), text.size_m2(inner_text(F.col("card"))).alias("size_m2"), attribute(F.col("card"), "img", "src").alias("img"))
    kept = read.filter(F.col("title").isNotNull() & prices.valid_price(F.col("price")) & (F.col("size_m2") > 0))
    images = F.when(F.coalesce("img", F.lit("")) != "", F.array("img")).otherwise(F.array().cast("array<string>"))
    return kept.select(text.external_id_before_last(F.col("url")).alias("external_id"), "url", "title", "price", text.capitalize(F.col("city_raw")).alias("city"), "size_m2", images.alias("images"), text.individual_title(F.col("title")).alias("is_individual"))


def adverts(pages: DataFrame, html: str, base: str, city: Column, least: int = 10_000) -> DataFrame:
    """Listings of pages of plain cards, with what their text tells of rooms, terrace and garage; only those over a least price."""
    held = pages.select(F.explode(cards(F.col(html))).alias("card"), text.capitalize(city).alias("city")).withColumn("said", inner_text(F.col("card")))
    read = held.select("*", by_tag(F.col("card"), "h2").alias("title"), prices.parse_price_digits(by_class(F.col("card"), "ma-AdPrice-value")).alias("price"), _on(base, attribute(F.col("card"), "a", "href")).alias("url"), text.size_m2(F.col("said")).alias("size_m2"), text.rooms(F.col("said")).alias("rooms"), text.has_terrace(F.col("said")).alias("terrace"), text.has_garage(F.col("said")).alias("garage"))
    kept = read.filter(F.col("title").isNotNull() & F.col("url").isNotNull() & F.coalesce(F.col("price") > least, F.lit(False)))
    score = scoring.amenity_score(F.col("terrace"), F.col("garage"))
    return kept.select(text.external_id_htm(F.col("url")).alias("external_id"), "url", "title", "price", "city", F.col("city").alias("neighborhood"), "size_m2", "rooms", text.truncate(F.col("said"), 500).alias("description"), score.alias("opportunity_score"), scoring.amenity_reasons(F.col("terrace"), F.col("garage")).alias("opportunity_reasons"))
