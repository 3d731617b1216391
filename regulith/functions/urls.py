"""URL helpers: host, canonical form, storage layout, links inside free text, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regulith.functions.text import squeeze_ws, strip
from regulith.session import col

# Query parameters that only track visits.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "ref", "source", "from", "spm",
]
# File extensions with their MIME types, and content types with their formats.
MIME_BY_EXTENSION = [
    (".pdf", "application/pdf"), (".html", "text/html"), (".htm", "text/html"),
    (".xml", "application/xml"), (".json", "application/json"), (".txt", "text/plain"),
    (".jpg", "image/jpeg"), (".jpeg", "image/jpeg"), (".png", "image/png"), (".tiff", "image/tiff"),
]
FORMAT_BY_CONTENT_TYPE = [
    ("text/html", "html"), ("application/pdf", "pdf"), ("application/xml", "xml"), ("text/xml", "xml"),
    ("application/json", "json"), ("text/plain", "text"),
]
# Entities decoded by strip_html, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]

URL_PARTS = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"
# URLs in prose, titled URLs, URLs up to a bracket, and the script, title and language patterns of pages.
TEXT_URL = r"""(https?://[^\s<>"{}|\\^`\[\]]+[^\s<>"{}|\\^`\[\].,;:!?])"""
TITLED_URL = r"""(?m)(?:^|\n)(?:\d+\.?\s*)?(.+?)[:：]\s*(https?://[^\s<>"{}|\\^`\[\]]+)"""

BARE_URL = r"(https?://[^\s)]+)"
SCRIPTS, TAGS = r"(?is)<script.*?</script>|<style.*?</style>", "<[^>]+>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LANG_ATTRIBUTE = r"""(?i)<html[^>]*lang=["']([^"']+)["']"""
LANG_META = r"""(?i)<meta[^>]*http-equiv=["']content-language["'][^>]*content=["']([^"']+)["']"""


def url_host(c: Column | str, strip_prefix: bool = False) -> Column:
    """Lower-case host without port; optionally without www., m., wap. in that order."""
    host = F.lower(F.regexp_extract(col(c), r"^(?:https?://)?([^/?:#]*)", 1))
    return F.regexp_replace(host, r"^(www\.)?(m\.)?(wap\.)?", "") if strip_prefix else host


def canonical_url(c: Column | str) -> Column:
    """https, no tracking parameters, no fragment, no trailing slash; other text stays as it is."""
    c = col(c)
    scheme, host, path, query = (F.regexp_extract(c, URL_PARTS, i) for i in (1, 2, 3, 4))
    secure = F.when(F.lower(scheme) == "http", F.lit("https")).otherwise(F.lower(scheme))
    tracked = F.array(*[F.lit(p) for p in TRACKING_PARAMS])
    kept = F.filter(
        F.split(query, "&"),
        lambda p: (F.length(p) > 0) & ~F.array_contains(tracked, F.lower(F.substring_index(p, "=", 1))),
    )
    kept = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    trimmed = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    joined = F.array_join(kept, "&")
    tail = F.when(F.length(joined) > 0, F.concat(F.lit("?"), joined)).otherwise(F.lit(""))
    return F.when(F.length(scheme) > 0, F.concat(secure, F.lit("://"), host, trimmed, tail)).otherwise(c)


def strip_html(c: Column | str) -> Column:
    c = F.regexp_replace(col(c), "<[^>]+>", "")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze_ws(F.translate(c, " ", " "))


def strip_script_html(c: Column | str) -> Column:
    c = F.regexp_replace(col(c), SCRIPTS, " ")
    return F.regexp_replace(c, TAGS, " ")


def html_title(c: Column | str) -> Column:
    title = squeeze_ws(F.regexp_extract(col(c), TITLE, 1))
    return F.nullif(F.substring(title, 1, 200), F.lit(""))


def html_lang(c: Column | str) -> Column:
    c = col(c)
    attr = F.regexp_extract(c, LANG_ATTRIBUTE, 1)
    meta = F.regexp_extract(c, LANG_META, 1)
    return F.coalesce(F.nullif(attr, F.lit("")), F.nullif(meta, F.lit("")))


def mime_from_path(c: Column | str) -> Column:
    lowered = F.lower(col(c))
    out = F
    for extension, mime in MIME_BY_EXTENSION:
        out = out.when(F.endswith(lowered, F.lit(extension)), F.lit(mime))
    return out.otherwise(F.lit("application/pdf"))


def doc_format(content_type: Column | str) -> Column:
    lowered = F.lower(col(content_type))
    out = F
    for needle, name in FORMAT_BY_CONTENT_TYPE:
        out = out.when(F.contains(lowered, F.lit(needle)), F.lit(name))
    return out.otherwise(F.lit("unknown"))


def storage_key(domain, stored_at, checksum, url, content_type) -> Column:
    """``domain/yyyy/mm/sha8/filename.ext`` with a safe file name."""
    path = F.regexp_extract(col(url), URL_PARTS, 3)
    name = F.element_at(F.split(path, "/"), -1)
    name = F.regexp_replace(F.when(F.length(name) > 0, name).otherwise("document"), r"[^\p{L}\p{N}_\-.]", "_")
    fmt = doc_format(content_type)
    extension = (
        F.when(fmt == "html", ".html").when(fmt == "pdf", ".pdf").when(fmt == "xml", ".xml")
        .when(fmt == "json", ".json").when(fmt == "text", ".txt").otherwise(".bin")
    )
    file = F.when(name.rlike(r"\.(html|pdf|xml|json|txt)$"), name).otherwise(F.concat(name, extension))
    return F.concat_ws(
        "/",
        F.replace(col(domain), F.lit("."), F.lit("_")),
        F.date_format(col(stored_at), "yyyy"),
        F.date_format(col(stored_at), "MM"),
        F.substring(col(checksum), 1, 8),
        file,
    )


def text_links(c: Column | str) -> Column:
    """Titled links first, then the remaining bare URLs: array<struct<title,url>>."""
    c = col(c)
    titles, urls = F.regexp_extract_all(c, F.lit(TITLED_URL), 1), F.regexp_extract_all(c, F.lit(TITLED_URL), 2)
    titled = F.zip_with(titles, urls, lambda t, u: F.struct(strip(t).alias("title"), strip(u).alias("url")))
    bare = F.filter(F.regexp_extract_all(c, F.lit(TEXT_URL), 1), lambda u: ~F.array_contains(urls, u))
    return F.concat(titled, F.transform(bare, lambda u: F.struct(F.lit("").alias("title"), u.alias("url"))))


def bare_urls(c: Column | str) -> Column:
    """URLs up to white space or a closing bracket, trailing punctuation removed, first-seen order."""
    found = F.regexp_extract_all(col(c), F.lit(BARE_URL), 1)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"""[.,);\]'"]+$""", "")))


def json_links(c: Column | str) -> Column:
    """Objects with a ``url`` inside JSON arrays embedded in text: array<struct<title,url>>."""
    arrays = F.regexp_extract_all(col(c), F.lit(r"(\[[\s\S]*?\])"), 1)
    parsed = F.transform(arrays, lambda a: F.from_json(a, "array<struct<title:string,url:string>>"))
    rows = F.flatten(F.filter(parsed, lambda a: a.isNotNull()))
    return F.filter(rows, lambda r: r["url"].isNotNull())


def robots_allowed(c: Column | str) -> Column:
    return ~F.contains(F.lower(col(c)), F.lit("disallow: /"))


def domain_suffixes(host: Column | str) -> Column:
    """Every dot-suffix of a host, both as ``a.b`` and as ``.a.b``: the keys an allowlist entry can equal.

    An entry ``x`` allows ``x`` and its subdomains; an entry ``.x`` allows only hosts ending in ``.x``.
    """
    labels = F.split(col(host), r"\.")
    n = F.size(labels)
    plain = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    dotted = F.transform(F.slice(plain, 2, F.greatest(n - 1, F.lit(0))), lambda s: F.concat(F.lit("."), s))
    return F.concat(plain, dotted)
