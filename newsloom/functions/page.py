"""Main text and metadata of web pages, as expressions without UDFs.

A page is cut into blocks at the tags that begin or end one. Whether a block is content follows from its words, the
share of them that are links, and the same of its two neighbours: the decision tree of Kohlschuetter, Fankhauser and
Nejdl (WSDM 2010) on shallow text features. All is linear in the page.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that hold no text of their own page, dropped with what is in them.
DROPPED = ("script", "style", "noscript", "template", "svg", "head", "nav", "footer", "aside", "form")
BLOCKS = ("address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h[1-6]", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul")
_ATTRS = r"(?:[ \t\r\n/][^>]*)?"
GONE = "(?is)<!--.*?-->|" + "|".join(f"<{e}{_ATTRS}>.*?</{e}[ \t\r\n]*>" for e in DROPPED)
BLOCK = f"(?i)</?(?:{'|'.join(BLOCKS)}){_ATTRS}>"
LINK, LINK_END, BREAK = f"(?i)<a{_ATTRS}>", "(?i)</a[ \t\r\n]*>", f"(?i)<br{_ATTRS}>"
#: Marks of where a link begins and ends while other tags are dropped.
OPEN, SHUT = "\u0001", "\u0002"
SPACE, WORD = "[ \t\r\n\u00a0]+", "[^ ]+"
#: Bounds of the tree: words and shares of links.
LINKED, BEFORE_LINKED, FEW, SOME, SOME_AFTER_LINKS, MANY = 1 / 3, 5 / 9, 4, 15, 17, 40
#: The entities that texts use, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _plain(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, SPACE, " "))


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def blocks(html: Column) -> Column:
    """The page's blocks that have text, in order: ``text``, ``words``, and ``linked`` words. A null page has none."""
    bare = F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), OPEN + SHUT, ""), GONE, " ")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, LINK, OPEN), LINK_END, SHUT), BREAK, " ")
    parts = F.transform(F.split(marked, BLOCK, -1), lambda x: F.regexp_replace(x, "<[^>]*>", ""))

    def one(x: Column) -> Column:
        links = F.array_join(F.regexp_extract_all(x, F.lit(f"{OPEN}[^{SHUT}]*"), F.lit(0)), " ")
        linked = _words(_plain(F.translate(links, OPEN, "")))
        return _bound(_plain(F.translate(x, OPEN + SHUT, "")), lambda text: F.struct(text.alias("text"), _words(text).alias("words"), linked.alias("linked")))

    return F.filter(F.transform(parts, one), lambda x: x["words"] > 0)


def _is_content(before: Column, own: Column, after: Column) -> Column:
    share = lambda x: F.coalesce(x["linked"] / x["words"], F.lit(0.0))
    words = lambda x: F.coalesce(x["words"], F.lit(0))
    after_links = (words(own) > MANY) | (words(after) > SOME_AFTER_LINKS)
    after_text = (words(own) > SOME + 1) | (words(after) > SOME) | (words(before) > FEW)
    return (share(own) <= LINKED) & F.when(share(before) <= BEFORE_LINKED, after_text).otherwise(after_links)


def content(found: Column) -> Column:
    """Those of a page's ``blocks`` that are content."""
    own = lambda all_of: F.filter(all_of, lambda x, i: _is_content(F.get(all_of, i - 1), x, F.get(all_of, i + 1)))
    return F.transform(_bound(found, own), lambda x: x["text"])


def main_text(html: Column) -> Column:
    """The content blocks of a page, a line each; empty where it has none or is null."""
    return F.array_join(content(blocks(html)), "\n")


def _meta(tags: Column, *names: str) -> Column:
    """The first non-empty content of the tags with the first of these names that has one."""
    found = []
    for name in names:
        own = F.filter(tags, lambda t: (t["name"] == name) & (t["content"] != ""))  # noqa: B023
        found.append(F.get(own, F.lit(0))["content"])
    return F.coalesce(*found, F.lit(None))


def metadata(html: Column) -> Column:
    """A struct of ``title``, ``author``, ``published``, ``image``, ``site`` and ``description``; null where unknown.

    Of each the first that is there: the page's meta tags, whatever the order of their attributes; its JSON-LD object,
    where that parses; for the title, the title element or the first heading.
    """
    quoted = lambda tag, names: F.regexp_extract(tag, rf"""(?is)[ \t\r\n"'](?:{names})[ \t\r\n]*=[ \t\r\n]*("[^"]*"|'[^']*')""", 1)
    value = lambda tag, names: F.regexp_replace(quoted(tag, names), """^["']|["']$""", "")
    tags = F.regexp_extract_all(html, F.lit("(?is)<meta[ \t\r\n][^>]*>"), F.lit(0))
    tags = F.transform(tags, lambda t: F.struct(F.lower(value(t, "name|property|itemprop")).alias("name"), _plain(value(t, "content")).alias("content")))
    ld = F.regexp_extract(html, r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>""", 1)
    inside = lambda pattern: F.nullif(_plain(F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]*>", "")), F.lit(""))
    found = F.struct(tags.alias("tags"), ld.alias("ld"))
    return _bound(found, lambda f: _fields(f["tags"], f["ld"], inside("(?is)<title[^>]*>(.*?)</title>"), inside("(?is)<h1[^>]*>(.*?)</h1>")))


def _fields(tags: Column, ld: Column, title: Column, heading: Column) -> Column:
    known = lambda *paths: F.coalesce(*[F.nullif(_plain(F.get_json_object(ld, p)), F.lit("")) for p in paths], F.lit(None))
    return F.struct(
        F.coalesce(_meta(tags, "og:title", "twitter:title"), known("$.headline", "$.name"), title, heading).alias("title"),
        F.coalesce(_meta(tags, "author", "article:author", "dc.creator"), known("$.author.name", "$.author[0].name")).alias("author"),
        F.coalesce(_meta(tags, "article:published_time", "datepublished", "date", "dc.date"), known("$.datePublished", "$.dateCreated")).alias("published"),
        F.coalesce(_meta(tags, "og:image", "twitter:image"), known("$.image.url", "$.image[0].url", "$.thumbnailUrl")).alias("image"),
        F.coalesce(_meta(tags, "og:site_name", "application-name"), known("$.publisher.name")).alias("site"),
        F.coalesce(_meta(tags, "og:description", "description"), known("$.description")).alias("description"),
    )
