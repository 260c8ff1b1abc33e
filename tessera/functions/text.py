"""Text and URL functions of listings, all as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide what a listing is.
KEYWORDS = ("piso", "casa", "vivienda", "alquiler", "vendo", "venta", "chalet", "inmueble", "hab", "dorm", "baño", "estudio", "loft", "duplex", "finca", "apartamento", "€", "euro", "precio", "m2", "particular", "inmobiliaria", "comunidad")
TERRACE = ("terraza", "balcón", "exterior")
GARAGE = ("garaje", "parking", "cochera", "plaza")
INDIVIDUAL = ("particular", "individual")
URGENCY = ("Urgente", "Oportunidad", "Bajada de precio", "Herencia")
LISTING_URLS = ("/vivienda/", "/inmueble/", "/anuncio/")
PORTAL_URLS = ("/vivienda/", "/inmueble/", "/anuncio/", "/piso/", "/comprar/", "/venta/")
PORTALS = {"fotocasa": "https://www.fotocasa.es", "habitaclia": "https://www.habitaclia.com", "pisos": "https://www.pisos.com"}
LIST_PAGES = ("/l", "/listado.htm", "/listado")


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds any of the words (nulls: false)."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return F.coalesce(found, F.lit(False))


#: White space of any kind, the no-break space before a euro sign too.
BLANK = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_ws(text: Column) -> Column:
    """Without white space of any kind at both ends; trim() takes spaces only."""
    return F.btrim(text, F.lit(BLANK))


def long_enough(text: Column, n: int = 50) -> Column:
    """Over n characters, also without white space at the ends."""
    return F.coalesce(F.length(strip_ws(text)) > n, F.lit(False))


def any_keyword(text: Column, words: Sequence[str] = KEYWORDS) -> Column:
    return any_of(F.lower(text), words)


def size_m2(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"([0-9]+)\s*m²", 1), F.lit("")).try_cast("int"), F.lit(0))


def rooms(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)([0-9]+)\s*hab", 1), F.lit("")).try_cast("int")


def has_terrace(text: Column) -> Column:
    return any_of(F.lower(text), TERRACE)


def has_garage(text: Column) -> Column:
    return any_of(F.lower(text), GARAGE)


def individual_title(title: Column) -> Column:
    return any_of(F.lower(title), INDIVIDUAL)


def is_agency(present: Column, is_individual: Column) -> Column:
    """Not an individual's: false where the field is absent, true where it is null."""
    return F.when(~present, F.lit(False)).otherwise(~F.coalesce(is_individual, F.lit(False)))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def external_id(url: Column) -> Column:
    """The last path segment up to its first dot."""
    return F.substring_index(last_segment(url), ".", 1)


def external_id_before_last(url: Column) -> Column:
    return F.try_element_at(F.split(url, "/"), F.lit(-2))


def external_id_htm(url: Column) -> Column:
    return F.replace(last_segment(url), F.lit(".htm"), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.substring_index(F.substring_index(url, "?", 1), "#", 1)


def canonical_url_bare(url: Column) -> Column:
    """Without query, fragment and slashes at the end."""
    return F.regexp_replace(canonical_url(url), "/+$", "")


def absolute_url(page: Column, href: Column) -> Column:
    """A relative link made absolute by the portal that its page is of."""
    base = F.lit("")
    for name, host in reversed(PORTALS.items()):
        base = F.when(page.contains(name), host).otherwise(base)
    return F.when(href.startswith("/"), F.concat(base, href)).otherwise(href)


def domain(url: Column) -> Column:
    return F.replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def is_listing_url(url: Column) -> Column:
    return any_of(url, LISTING_URLS)


def is_portal_listing(url: Column) -> Column:
    """A listing's page on a known portal, not a list of listings."""
    not_list = F.lit(True)
    for end in LIST_PAGES:
        not_list = not_list & ~url.endswith(end)
    return F.coalesce(any_of(url, PORTAL_URLS) & any_of(F.lower(url), tuple(PORTALS)) & not_list, F.lit(False))


def links(html: Column) -> Column:
    """Targets of all links of a page, quoted or bare, of 10 characters at least."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s(?:[^>]*\s)?href\s*=\s*("[^"]+"|'[^']+'|[^\s>"']+)"""), F.lit(1))
    return F.filter(F.transform(raw, lambda h: F.regexp_replace(h, r"""^["']|["']$""", "")), lambda h: F.length(h) >= 10)


def group_url(group: Column) -> Column:
    """A group's mobile page from its number, name or page."""
    return F.when(group.startswith("http") & ~group.rlike("^[0-9]+$"), F.replace(group, F.lit("www.facebook.com"), F.lit("m.facebook.com"))).otherwise(F.concat(F.lit("https://m.facebook.com/groups/"), group))


def clean_group_id(text: Column) -> Column:
    bare = text
    for prefix in ("https://www.facebook.com/groups/", "https://m.facebook.com/groups/"):
        bare = F.replace(bare, F.lit(prefix), F.lit(""))
    return F.substring_index(F.substring_index(bare, "/", 1), "?", 1)


def capitalize(text: Column) -> Column:
    """First letter upper, all others lower (initcap would raise each word's)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def fragment_hash(title: Column, price: Column) -> Column:
    """12 hexadecimal digits of the MD5 of title and price, the price with one decimal at least."""
    written = F.when(price == F.floor(price), F.concat(price.cast("decimal(18,0)").cast("string"), F.lit(".0"))).otherwise(price.cast("string"))
    return F.substring(F.md5(F.concat(title, written)), 1, 12)


def post_url(group: Column, fragment: Column) -> Column:
    return F.concat(group, F.lit("?post_id="), fragment)


def default_title(title: Column, city: Column, city_present: Column) -> Column:
    """The title, or one made from the city ("None" for a null city, Málaga for an absent one)."""
    place = F.when(~city_present, F.lit("Málaga")).otherwise(F.coalesce(city, F.lit("None")))
    return F.when(F.coalesce(title, F.lit("")).isin("", "None"), F.concat(F.lit("Propiedad en "), place)).otherwise(title)


def strip_fence(text: Column) -> Column:
    """The inside of a fenced JSON block, or the text itself."""
    inside = F.regexp_extract(text, r"(?s)```json(.*?)```", 1)
    return strip_ws(F.when(inside != "", inside).otherwise(text))


def split_csv(text: Column, keep_empty: bool = False) -> Column:
    parts = F.transform(F.split(text, ","), strip_ws)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def split_ws(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def join_csv(parts: Column) -> Column:
    return F.array_join(parts, ", ")


def toggle(parts: Column, item: Column) -> Column:
    """Without the item if it is there, with it at the end if not."""
    return F.when(F.array_contains(parts, item), F.array_remove(parts, item)).otherwise(F.array_append(parts, item))


def source_enabled(csv: Column, name: Column) -> Column:
    """Exact membership in a comma-separated list."""
    return F.array_contains(split_csv(csv), name)


def source_shown(csv: Column, name: Column) -> Column:
    """Substring membership: what a settings page ticks, also where a source's name is part of another's."""
    return F.coalesce(F.contains(csv, name), F.lit(False))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def registry_ref(xml: Column) -> Column:
    """Both parts of a land-registry reference, null if either is missing."""
    pattern = r"(?s)<pc1>(.*?)</pc1>.*?<pc2>(.*?)</pc2>"
    return F.when(xml.rlike(pattern), F.concat(F.regexp_extract(xml, pattern, 1), F.regexp_extract(xml, pattern, 2)))


def registry_fields(xml: Column) -> Column:
    """surface_m2, year_built and use of a land-registry answer, with defaults 0, 0 and Residencial."""
    tag = lambda name: F.nullif(F.regexp_extract(xml, f"<{name}>(.*?)</{name}>", 1), F.lit(""))
    return F.struct(
        F.coalesce(F.regexp_replace(tag("sfc"), "^([^,]*),", "$1.").try_cast("double"), F.lit(0.0)).alias("surface_m2"),
        F.coalesce(F.regexp_extract(tag("ant"), r"^\s*([0-9]+)", 1).try_cast("int"), F.lit(0)).alias("year_built"),
        F.coalesce(tag("uso"), F.lit("Residencial")).alias("use"),
    )


def urgency_signals(text: Column) -> Column:
    """Which of the urgency words a text holds."""
    return F.filter(F.array(*map(F.lit, URGENCY)), lambda w: F.contains(F.lower(text), F.lower(w)))


def normalise_city(city: Column) -> Column:
    """Accents dropped, so that spellings of one city agree."""
    return F.translate(city, "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")


def first_truthy(*values: Column, kind: str = "number") -> Column:
    """The first value that is neither null nor zero, an empty text or an empty array. kind: number, text or array."""
    if kind == "array":
        return F.coalesce(*(F.when(F.size(v) > 0, v) for v in values))
    return F.coalesce(*(F.nullif(v, F.lit("" if kind == "text" else 0)) for v in values))


def first_image(images: Column, placeholder: str) -> Column:
    return F.coalesce(F.try_element_at(images, F.lit(1)), F.lit(placeholder))


def is_verified(ref: Column) -> Column:
    return F.coalesce(ref, F.lit("")) != ""


def display_default(value: Column, default: str) -> Column:
    """The number as text; null and 0 show the default."""
    return F.coalesce(F.nullif(value, F.lit(0)).cast("string"), F.lit(default))


def has_discrepancy(reasons: Column) -> Column:
    return F.coalesce(F.exists(reasons, lambda r: r.contains("Discrepancia")), F.lit(False))


def matches(term: str, *columns: Column) -> Column:
    """Case-insensitive substring of any column; the empty term matches all rows."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.coalesce(c, F.lit(""))).contains(term.lower())
    return found


def embed_text(title: Column, city: Column, description: Column) -> Column:
    shown = lambda c: F.coalesce(c, F.lit("null"))
    return truncate(F.concat(shown(title), F.lit(" "), shown(city), F.lit(" "), F.coalesce(description, F.lit(""))), 1000)


def context_line(title: Column, city: Column, price: Column) -> Column:
    """A listing as a line of a prompt; nulls print as null."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.concat(F.lit("- "), shown(title), F.lit(" en "), shown(city), F.lit(": "), shown(price), F.lit("€"))
