"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (text in a path pattern, page type), in the order in which they are tried.
TYPE_HINTS = (("artist", "artist"), ("artwork", "artwork"), ("exhibition", "exhibition"), ("event", "event"), ("venue", "venue"), ("gallery", "venue"), ("news", "listing"), ("blog", "listing"))
#: Fixed values: (path part, page type) of detail pages, and the path parts of utility pages.
DETAIL = (("artist", "artist_profile"), ("artists", "artist_profile"), ("event", "event_detail"), ("events", "event_detail"), ("exhibition", "exhibition_detail"), ("exhibitions", "exhibition_detail"), ("venue", "venue_profile"), ("venues", "venue_profile"), ("artwork", "artwork_detail"), ("artworks", "artwork_detail"))
UTILITY = ("privacy", "terms", "cookie", "cookies", "login", "account", "contact", "about")
#: Fixed values: (pattern of a URL in any case, page type); the first that matches counts.
PAGE_TYPES = (
    ("/artists/[a-zA-Z]/?$", "artist_directory_letter"),
    (r"/[^/]+/about\.php/?$", "artist_biography"),
    (r"/[^/]+/exhibitions\.php/?$", "artist_exhibitions"),
    (r"/[^/]+/articles\.php/?$", "artist_articles"),
    (r"/[^/]+/press(?:-reviews)?\.php/?$", "artist_press"),
    (r"/[^/]+/memories\.php/?$", "artist_memories"),
    ("/artist[s]?/[^/]+/?$", "artist_profile"),
    ("/artist[s]?/?$", "artist_directory"),
    ("/event[s]?/[^/]+/?$", "event_detail"),
    ("/event[s]?/?$", "event_listing"),
    ("/what[s-]?[-_]?on/?", "event_listing"),
    ("/exhibition[s]?/[^/]+/?$", "exhibition_detail"),
    ("/exhibition[s]?/?$", "exhibition_listing"),
    ("/show[s]?/[^/]+/?$", "exhibition_detail"),
    ("/venue[s]?/?$", "venue_profile"),
    ("/gallery/?$", "venue_profile"),
    ("/artwork[s]?/[^/]+/?$", "artwork_detail"),
    ("/artwork[s]?/?$", "artwork_listing"),
    ("/shop/?$", "artwork_listing"),
    ("/portfolio/?$", "artwork_listing"),
)
#: JSON-LD types and the page types they stand for.
LD_TYPES = {"Person": "artist_profile", "Artist": "artist_profile", "Event": "event_detail", "ExhibitionEvent": "event_detail", "MusicEvent": "event_detail", "Exhibition": "exhibition_detail", "LocalBusiness": "venue_profile", "Museum": "venue_profile", "ArtGallery": "venue_profile", "VisualArtwork": "artwork_detail", "Product": "artwork_detail"}
#: Marks of a page that asks whether one is human.
CAPTCHA = ("captcha", "g-recaptcha", "hcaptcha", "cf-chl", "cloudflare challenge", "are you human")
#: Path texts that keep a family out of a crawl, and that mark utility families.
EXCLUDED = ("/login", "/account", "/cart", "/search", "/privacy", "/terms")
UTILITY_FAMILY = ("privacy", "terms", "contact", "about", "cookie", "sitemap", "rss", "feed")
#: What a family's page type candidate stands for; texts of a pattern or page that tell a type, in order; texts of listings and of archives.
FAMILY_TYPES = {"listing": "listing", "generic_detail": "detail", "artist": "artist", "artwork": "artwork", "exhibition": "exhibition", "event": "exhibition", "document": "document"}
FAMILY_SIGNS = (("artist", ("artist",)), ("artwork", ("artwork", "/works/")), ("exhibition", ("exhibition", "event", "show")), ("document", (".pdf", "document", "catalogue", "catalog")))
LISTING_TOKENS = ("artists", "artworks", "exhibitions", "events", "news", "blog", "index", "archive")
ARCHIVE_TOKENS = ("archive", "archives", "year", "past")
#: Fixed values: (section, texts in its URL; without slashes also in its name), and (pagination, texts in the URL).
SECTIONS = (
    ("artist_directory", ("/artists", "/artist", "/our-artists", "/gallery-artists")),
    ("event_listing", ("/events", "/event", "/whats-on", "/what-s-on", "/what's-on", "/upcoming")),
    ("exhibition_listing", ("/exhibitions", "/exhibition", "/shows", "/current-shows", "/past-shows")),
    ("artwork_listing", ("/artworks", "/artwork", "/shop", "/works", "/portfolio", "/gallery")),
    ("venue_profile", ("/venue", "/about", "/contact", "/gallery-info")),
)
PAGINATION = (("letter", ("?letter=", "/a-z", "?page=a", "[a-z]")), ("numbered", ("?page=", "/page/", "?p=")))
#: A link's target: the href of an a tag, quoted or not, in any case.
LINK = r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normalize_url(url: Column) -> Column:
    """Lower scheme and host, no default port, no fragment, no slash at the end, query pairs sorted; https and / where missing."""
    full = F.when(url.rlike("^[A-Za-z]+://"), url).otherwise(F.concat(F.lit("https://"), url))
    scheme = F.lower(F.regexp_extract(full, "^([A-Za-z]+)://", 1))
    place = F.lower(F.regexp_extract(full, r"^[A-Za-z]+://([^/?#]*)", 1))
    place = F.when(scheme == "http", F.regexp_replace(place, ":80$", "")).when(scheme == "https", F.regexp_replace(place, ":443$", "")).otherwise(place)
    bare = F.regexp_replace(path(full), "/+$", "")
    bare = F.when(bare == "", "/").otherwise(bare)
    pairs = F.array_join(F.array_sort(F.filter(F.split(query(full), "&"), lambda x: x != "")), "&")
    return F.concat(scheme, F.lit("://"), place, bare, F.when(pairs == "", "").otherwise(F.concat(F.lit("?"), pairs)))


def path_pattern(url: Column) -> Column:
    """The path with numbers, long hexadecimal parts and parts with digits as placeholders."""
    parts = F.transform(
        F.filter(F.split(path(url), "/"), lambda x: x != ""),
        lambda x: F.when(x.rlike("^[0-9]+$"), "{num}").when(x.rlike("^[0-9a-fA-F]{8,}$"), "{hex}").when(x.rlike("[0-9]"), "{slug}").otherwise(F.lower(x)),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda x: x != ""))


def page_type_candidate(pattern: Column) -> Column:
    """The first hint that the pattern holds, otherwise by depth."""
    levels = F.size(F.filter(F.split(pattern, "/"), lambda x: x != ""))
    out = F.when(F.lit(False), "")
    for hint, kind in TYPE_HINTS:
        out = out.when(F.contains(F.lower(pattern), F.lit(hint)), kind)
    return out.when(levels <= 1, "listing").otherwise("generic_detail")


def family_type(pattern: Column, signals: Column | None = None) -> Column:
    """The page type that a path pattern, and what its pages show, speak for: the first sign that holds, else a listing's words, else detail from three parts on."""
    blob = F.lower(F.concat_ws(" ", pattern, signals if signals is not None else F.lit("")))
    out = F.when(F.lit(False), "")
    for kind, words in FAMILY_SIGNS:
        out = out.when(holds(blob, words), kind)
    parts = F.size(F.filter(F.split(F.lower(pattern), "/"), lambda x: x != ""))
    return out.when(holds(blob, LISTING_TOKENS), "listing").when(parts >= 3, "detail").otherwise("generic")


def resolve_page_type(candidate: Column, confidence: Column, pattern: Column, signals: Column | None = None) -> tuple[Column, Column]:
    """(page type, conflict): what the candidate stands for from a confidence of .72 on, else what the pattern speaks for, in conflict if the two differ."""
    mapped = F.when(F.lit(False), "")
    for name, kind in FAMILY_TYPES.items():
        mapped = mapped.when(F.lower(candidate) == name, kind)
    mapped, own = mapped.otherwise("generic"), family_type(pattern, signals)
    sure = confidence >= 0.72
    return F.when(sure, mapped).otherwise(own), ~sure & (mapped != own)


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds any of the words, as they stand."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def predicted_type(url: Column) -> Column:
    """The detail type whose word begins a path part, else utility or generic."""
    p = F.lower(path(url))
    out = F.when(F.lit(False), "")
    for word, kind in DETAIL:
        out = out.when(F.contains(p, F.lit("/" + word)), kind)
    return out.when(holds(p, tuple("/" + w for w in UTILITY)), "utility").otherwise("generic")


def priority_of(page_type: Column) -> Column:
    """80 for detail types, 5 for utility pages, 30 for generic ones, 50 for other hinted types."""
    return F.when(page_type.isin(*sorted({k for _, k in DETAIL})), 80).when(page_type == "utility", 5).when(page_type == "generic", 30).otherwise(50)


def score_url(url: Column) -> Column:
    return priority_of(predicted_type(url))


def url_page_type(url: Column, rules: tuple[tuple[str, str], ...] = PAGE_TYPES) -> Column:
    """The type of the first rule (pattern, type) that the full URL matches in any case, else null."""
    out = F.when(F.lit(False), "")
    for pattern, kind in rules:
        out = out.when(url.rlike("(?i)" + pattern), kind)
    return out


def without_dots(p: Column) -> Column:
    """A path without . and .. parts; they leave a slash where they stand last."""
    parts = F.split(p, "/")
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), lambda a, x: F.when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).when(x == ".", a).otherwise(F.concat(a, F.lit("/"), x)))
    out = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.lit("/"))).otherwise(kept)
    return F.when(out == "", "/").otherwise(out)


def resolve(base: Column, href: Column) -> Column:
    """An href as an absolute URL without fragment; null for empty ones, fragments, and schemes other than http and https."""
    root = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*)", 1)
    own = F.when(path(base) == "", "/").otherwise(path(base))
    link = F.regexp_replace(F.trim(href), "#.*$", "")
    target, rest = F.regexp_extract(link, r"^([^?]*)", 1), F.regexp_extract(link, r"(\?.*)$", 1)
    below = F.concat(F.regexp_extract(own, "^(.*/)", 1), target)
    return (
        F.when((link == "") | link.isNull(), None)
        .when(link.rlike("(?i)^https?://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, own, link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, without_dots(target), rest))
        .otherwise(F.concat(root, without_dots(below), rest))
    )


def profile_candidate(url: Column, reserved: tuple[str, ...]) -> Column:
    """One path part, without a dot, that is not reserved."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    slug = F.lower(F.get(parts, 0))
    return (F.size(parts) == 1) & ~F.contains(slug, F.lit(".")) & ~slug.isin(*reserved)


def family_key(url: Column) -> Column:
    """host::first path part; null without one, and for .php."""
    part = F.get(F.filter(F.split(path(url), "/"), lambda x: x != ""), 0)
    return F.when(part.isNotNull() & ~F.lower(part).endswith(".php"), F.concat(host(url), F.lit("::"), F.lower(part)))


def pagination_of(url: Column) -> Column:
    """Of a group of URLs, as an aggregate: how their pages are numbered."""
    return F.when(F.bool_or(url.rlike("[?&](page|p|offset|start)=")), "query_param").when(F.bool_or(url.rlike("/page/[0-9]+")), "path_segment").otherwise("none")


def include_rule(pattern: Column, confidence: Column, size: Column, page_type: Column) -> Column:
    """Whether a family is crawled: not with excluded or utility words or when small and unsure; large or sure ones are, else known types from .45 on."""
    low = F.lower(pattern)
    blocked = holds(low, EXCLUDED) | holds(low, UTILITY_FAMILY)
    return F.when(blocked | ((confidence < 0.35) & (size <= 1)), False).when((size >= 3) | (confidence >= 0.7), True).otherwise(page_type.isin("listing", "artist", "artwork", "exhibition", "detail") & (confidence >= 0.45))


def section_type(name: Column, url: Column) -> Column:
    """The content type of a navigation link by its URL or name."""
    out = F.when(F.lit(False), "")
    for kind, words in SECTIONS:
        out = out.when(holds(F.lower(url), words) | holds(F.lower(name), tuple(w.strip("/") for w in words)), kind)
    return out.otherwise("unknown")


def section_pagination(url: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, words in PAGINATION:
        out = out.when(holds(F.lower(url), words), kind)
    return out.otherwise("none")


def expand_urls(base: Column, letters: Column) -> Column:
    """base with {letter} replaced by each of the letters."""
    return F.transform(letters, lambda x: F.replace(base, F.lit("{letter}"), x))


def normalize_email(value: Column) -> Column:
    """The first address in a value, lower-cased, without mailto and query."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^mailto:|\?.*$", "")
    return F.nullif(F.regexp_extract(bare, r"([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]+)", 1), F.lit(""))


def captcha_flag(html: Column) -> Column:
    return F.coalesce(holds(F.lower(html), CAPTCHA), F.lit(False))
