"""Scalar text functions of the news engine, as DataFrame expressions without UDFs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Honorifics of which one leading one is dropped (no word boundary), and boilerplate phrases.
HONORIFICS = ("mr", "mrs", "ms", "dr", "prof", "sen", "rep", "gov", "gen", "col", "lt", "cpt", "maj", "capt", "sgt", "ambassador", "judge", "attorney", "sheriff", "officer", "detective")
BOILERPLATE = (
    r"subscribe\s+(to|now)", r"download\s+the\s.*app", r"become\s+a\s.*patriot", r"click\s+here", r"watch\s+(more|24/7|247)", r"sign\s+up",
    r"newsletter", r"licensing@", r"all rights reserved", r"fox news channel \(fnc\)|fnc is", r"ms\s+now", r"my\s+source\s+for\s+news",
    r"cbs news 24.?7", r"available for archive", r"by emailing", r"©", r"be part of it", r"touch to listen to cbs news",
)
URL_MARKS = r"[^:/?#\[\]@!$&()*+,;=]"


def normalize(text: Column) -> Column:
    """Canonical form of an entity: lower case, one honorific dropped, possessives and punctuation removed."""
    out = F.trim(F.lower(text))
    out = F.regexp_replace(out, rf"^(?:{'|'.join(HONORIFICS)})\.?\s*", "")
    out = F.when(F.contains(out, F.lit("'s")), F.regexp_replace(out, r"(?U)'s\b", "")).otherwise(out)
    out = F.regexp_replace(out, r"(?U)[^a-z0-9 \w\s]+", "")  # also what is left of s'; the plain letters come first, as the quick test
    return F.trim(F.regexp_replace(out, r"\s{2,}|[\s&&[^ ]]", " "))


def role_id(role: Column, normalized: Column) -> Column:
    """The role's deterministic id: 16 hex digits of SHA-256 over ``role:{role}:{normalized}``."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit("role"), role, normalized), 256), 1, 16)


def is_boilerplate(text: Column) -> Column:
    """A boilerplate phrase, or over 15 % URL punctuation in more than 20 characters."""
    phrase = F.lower(text).rlike("|".join(f"(?:{p})" for p in BOILERPLATE))
    marks = F.length(F.regexp_replace(text, URL_MARKS, ""))
    return phrase | ((F.length(text) > 20) & (marks / F.length(text) > 0.15))


def normalize_source(source_id: Column) -> Column:
    """The source without its feed suffix."""
    return F.regexp_replace(source_id, "_(yt|rss|tw|fb)$", "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; about 0 where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-10))


def title_of(text: Column) -> Column:
    """The text before the first full stop or line end."""
    return F.trim(F.split(text, r"[.\n]", 2)[0])


def domain(url: Column) -> Column:
    """The host with its port, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


#: The meta tags that name a page's picture, first match in this order.
PICTURE_TAGS = (
    r"""<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']""",
    r"""<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:image["']""",
    r"""<meta[^>]+name=["']twitter:image["'][^>]+content=["']([^"']+)["']""",
    r"""<meta[^>]+content=["']([^"']+)["'][^>]+name=["']twitter:image["']""",
)
#: Hosts that hold one of these are not ingested.
BLOCKED = ("msn.com", "msn.co.uk", "msn.es", "msn.fr", "msn.it", "msn.de")
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def picture(html: Column) -> Column:
    """The picture that a page's meta tags name, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(html, f"(?i){p}", 1), F.lit("")) for p in PICTURE_TAGS])


def mail_time(raw: Column) -> Column:
    """An RFC 2822 date as a timestamp; null for other texts. The weekday is not checked."""
    rest = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(*[F.try_to_timestamp(rest, F.lit(f"d MMM yyyy HH:mm:ss {zone}")) for zone in ("xx", "z")])


def iso_time(raw: Column) -> Column:
    """An ISO 8601 date and time as a timestamp, in UTC where it names no zone; null for other texts."""
    shaped = raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$")
    zoned = F.when(raw.rlike(r":\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), raw).when(F.length(raw) == 10, F.concat(raw, F.lit("T00:00:00Z"))).otherwise(F.concat(raw, F.lit("Z")))
    return F.when(shaped, F.try_to_timestamp(zoned))


def own_day(raw: Column) -> Column:
    """``yyyy-mm-dd`` as the date's own offset has it; null where there is no date in front."""
    month = F.regexp_extract(raw, r"^(?:[A-Za-z]{3},\s*)?\d{1,2} ([A-Z][a-z]{2}) \d{4}", 1)
    mail = F.concat_ws(
        "-", F.regexp_extract(raw, r" (\d{4}) ", 1), F.lpad(((F.position(month, F.lit(MONTHS)) + 2) / 3).cast("int").cast("string"), 2, "0"),
        F.lpad(F.regexp_extract(raw, r"^(?:[A-Za-z]{3},\s*)?(\d{1,2}) ", 1), 2, "0"),
    )
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(raw, 1, 10)).when(month != "", mail)


def escape_html(s: Column) -> Column:
    """The text with ``& < > "`` as entities."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(mark), F.lit(name))
    return s


def author(metadata: Column) -> Column:
    """What follows the last bar, or nothing where there is no bar."""
    return F.when(metadata.contains("|"), F.trim(F.substring_index(metadata, "|", -1))).otherwise("")


def video_embed(url: Column) -> Column:
    """The embedding URL of a known video host, or null."""
    yt = F.regexp_extract(url, r"(?:youtube\.com/watch\?v=|youtu\.be/)([\w-]+)", 1)
    ru = F.regexp_extract(url, r"rumble\.com/(?:embed/)?(v[\w-]+)", 1)
    return F.when(yt != "", F.concat(F.lit("https://www.youtube.com/embed/"), yt)).when(ru != "", F.concat(F.lit("https://rumble.com/embed/"), ru))


def thumbnail(found: Column) -> Column:
    """The first picture of a search result (JSON) that is an address: its image source, thumbnail or image; else null."""
    own = [F.get_json_object(found, f"$.{k}") for k in ("img_src", "thumbnail", "image")]
    return F.coalesce(*[F.when(x.startswith("http"), x) for x in own])


def visible_text(html: Column) -> Column:
    """The page without scripts, styles and tags, spaces collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def links(html: Column, url: Column) -> Column:
    """The page's distinct links to its own host, sorted, without fragments; relative ones are resolved."""
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(origin, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^/?#]*)*)/", 1), F.lit("/"))
    found = F.regexp_extract_all(html, F.lit(r"""href=["']([^"'#]+)"""), F.lit(1))
    full = F.transform(found, lambda x: F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), x).when(x.startswith("/"), F.concat(origin, x)).otherwise(F.concat(folder, x)))
    return F.array_sort(F.array_distinct(F.filter(full, lambda x: x.rlike("^https?://") & (domain(x) == domain(url)))))


def runs(items: Column) -> Column:
    """Of a sorted array ``(item, n)``: each distinct item and how often it comes."""
    bound = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # evaluated once, not for each element
    first = lambda x: F.filter(F.transform(x, lambda _, i: i), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))
    run = lambda x, at: F.transform(at, lambda i, j: F.struct(F.get(x, i).alias("item"), (F.coalesce(F.get(at, j + 1), F.size(x)) - i).cast("long").alias("n")))
    return bound(items, lambda x: bound(first(x), lambda at: run(x, at)))
