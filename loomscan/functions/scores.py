"""Text, score, vector and decision expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names that a record type may come under; others are refused.
TYPE_ALIASES = {"artist": "artist", "artwork": "artwork", "exhibition": "exhibition", "event": "event", "venue": "venue", "organization": "organization", "artist_article": "artwork", "artist_press": "artwork", "artist_memory": "artwork", "article": "artwork"}
#: Fields of each record type, the critical ones first.
TYPE_FIELDS = {
    "artist": (("title", "source_url"), ("bio", "nationality", "birth_year", "website_url", "instagram_url", "email", "avatar_url", "mediums", "collections")),
    "event": (("title", "source_url", "start_date"), ("venue_name", "end_date", "description", "ticket_url", "price_text", "curator", "is_free")),
    "exhibition": (("title", "source_url", "start_date"), ("venue_name", "end_date", "description", "curator", "ticket_url", "price_text", "artist_names")),
    "venue": (("title", "source_url"), ("address", "city", "country", "phone", "opening_hours", "website_url", "email")),
    "artwork": (("title", "source_url"), ("medium", "year", "artist_names", "dimensions", "price", "description")),
}
#: Fixed values: (label, weight) of the checks of an artist's completeness.
ARTIST_CHECKS = (("artist_name", 20), ("bio", 20), ("website_or_email", 15), ("images", 10), ("exhibitions_articles_press", 20), ("location_or_nationality", 5), ("source_pages", 10))
#: Words of image roles.
PROFILE_IMAGE = ("portrait", "headshot", "avatar", "profile", "author", "artist-photo")
ARTWORK_IMAGE = ("artwork", "painting", "sculpture", "drawing", "canvas")
TEMPLATE_IMAGE = ("header", "footer", "nav", "menu", "background")
TEMPLATE_ZONE = ("header", "footer", "nav", "menu", "sidebar")
DECORATIVE_IMAGE = ("poster", "exhibition", "event", "banner", "flyer", "icon", "logo", "sprite")


def normalize_name(name: Column) -> Column:
    """Trimmed, lower, blanks collapsed, then all but a-z, 0-9 and blanks dropped, in that order."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"[ \t\r\n]+", " "), "[^a-z0-9 ]", "")


def normalize_record_type(value: Column) -> Column:
    """One of the six types; null for names that are none of them."""
    low = F.lower(F.trim(value))
    out = F.when(F.lit(False), "")
    for k, v in TYPE_ALIASES.items():
        out = out.when(low == k, v)
    return out


def record_fingerprint(record_type: Column, *fields: tuple[str, Column]) -> Column:
    """SHA-256 of version, type and the folded fields in name order; nulls count as empty."""
    parts = [F.concat(F.lit(k + "="), F.coalesce(F.trim(F.lower(v)), F.lit(""))) for k, v in sorted(fields, key=lambda x: x[0])]
    return F.sha2(F.concat_ws("|", F.lit("v1"), record_type, *parts), 256)


def item_fingerprint(url: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", url, text).cast("binary"))


def let(value: Column, body) -> Column:
    """body of the value, which is computed once and not for each element that body visits."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def name_tokens(text: Column) -> Column:
    """Lower-cased words between blanks and hyphens, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s-]+"), lambda x: x != ""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def hash_embedding(text: Column, buckets: int = 96) -> Column:
    """Counts of hashed words, of length one, to 6 places; zeros for a text without words."""
    own = F.transform(tokens(text), lambda w: (F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    counts = let(own, lambda x: F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(x, lambda y: y == b)).cast("double")))
    return let(F.struct(counts.alias("c")), lambda s: let(F.sqrt(F.aggregate(s["c"], F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(s["c"], lambda x: F.when(n > 0, F.round(x / n, 6)).otherwise(F.lit(0.0)))))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)


def cosine_similarity(left: Column, right: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero vectors."""
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when((F.size(left) > 0) & (F.size(left) == F.size(right)) & (norm > 0), dot(left, right) / F.nullif(norm, F.lit(0.0))).otherwise(0.0)


def parse_embedding(value: Column) -> Column:
    """JSON text to doubles; bad text, NaN and infinite values give an empty array."""
    parsed = F.from_json(value, "array<double>")
    ok = parsed.isNotNull() & F.forall(parsed, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, parsed).otherwise(F.array().cast("array<double>"))


def record_text(record_type: Column, title: Column, description: Column, nationality: Column) -> Column:
    """The text that an artist or exhibition is embedded by; null for other types."""
    return F.when(record_type == "artist", F.concat_ws(" ", title, nationality, description)).when(record_type == "exhibition", F.concat_ws(" ", title, description))


def present(value: Column) -> Column:
    return value.isNotNull() & ~F.trim(value).isin("", "[]", "{}")


def completeness(fields: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(percent of fields present, cut off; names of the missing ones, sorted and joined)."""
    have = sum((present(c).cast("int") for _, c in fields), F.lit(0))
    missing = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(present(c), F.lit(False)), n) for n, c in fields]))), ",")
    return F.floor(have * 100 / len(fields)).cast("int"), missing


def _listed(names: list[Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*names)), ",")


def typed_completeness(record_type: Column, have: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(percent of a type's fields that are present, cut off; the missing fields; the critical ones of them). Types without a list give 0 and none."""
    there = lambda f: F.coalesce(present(have[f].cast("string")), F.lit(False)) if f in have else F.lit(False)
    score, missing, critical = (F.when(F.lit(False), F.lit(None).cast(t)) for t in ("int", "string", "string"))
    for kind, (first, rest) in TYPE_FIELDS.items():
        own = record_type == kind
        count = sum((F.when(there(f), 1).otherwise(0) for f in (*first, *rest)), F.lit(0))
        score = score.when(own, F.floor(count * 100 / len((*first, *rest))).cast("int"))
        missing = missing.when(own, _listed([F.when(~there(f), f) for f in (*first, *rest)]))
        critical = critical.when(own, _listed([F.when(~there(f), f) for f in first]))
    return score.otherwise(0), missing.otherwise(""), critical.otherwise("")


def artist_completeness(*holds: Column) -> tuple[Column, Column]:
    """(sum of the weights of the seven checks that hold, in their order; labels of the others)."""
    return weighted_checks([(label, check, weight) for (label, weight), check in zip(ARTIST_CHECKS, holds, strict=True)])


def confidence_score(record_type: Column, title: Column, description: Column, date: Column, venue: Column, artists: Column, image: Column, json_ld: Column, model: Column) -> tuple[Column, Column, Column]:
    """(score, band, reasons) of what is there; dates count for events and exhibitions, a model's confidence from 80 on."""
    checks = [
        (title, 20, F.lit("title present")), (description, 15, F.lit("description present")), (record_type.isin("event", "exhibition") & date, 15, F.lit("date present")), (venue, 10, F.lit("venue present")),
        (artists, 10, F.lit("artists linked")), (image, 15, F.when(record_type == "artist", "avatar image found").otherwise("image found")), (json_ld, 10, F.lit("JSON-LD source")), (model >= 80, 5, F.lit("high AI confidence")),
    ]
    score = F.least(sum((F.when(c, w).otherwise(0) for c, w, _ in checks), F.lit(0)), F.lit(100))
    return score, band(score), _listed([F.when(c, why) for c, _, why in checks])


def weighted_checks(checks: list[tuple[str, Column, int]]) -> tuple[Column, Column]:
    """(sum of the weights of the checks that hold, at most 100; labels of those that do not)."""
    total = sum((F.when(c, w).otherwise(0) for _, c, w in checks), F.lit(0))
    return F.least(total, F.lit(100)), F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c, _ in checks])), ",")


def band(score: Column) -> Column:
    return F.when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def field_confidence(value: Column, own: Column, fallback: Column) -> Column:
    return F.when(present(value), F.coalesce(own, fallback))


def year_range(text: Column) -> tuple[Column, Column]:
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9][0-9])\b"), 1), lambda x: x.cast("int"))
    return F.array_min(years), F.array_max(years)


def date_text(text: Column) -> Column:
    """The first two date-like strings, joined."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4})"), 1)
    return F.nullif(F.array_join(F.slice(found, 1, 2), " - "), F.lit(""))


def next_eligible(policy: Column, now: Column) -> Column:
    """realtime 5 minutes, daily, weekly, monthly 30 days, manual never; others as daily."""
    return F.when(policy == "realtime", now + F.expr("interval '5' minute")).when(policy == "weekly", now + F.expr("interval '7' day")).when(policy == "monthly", now + F.expr("interval '30' day")).when(policy == "manual", F.lit(None).cast("timestamp")).otherwise(now + F.expr("interval '1' day"))


def content_change(hash_a: Column, hash_b: Column, etag_a: Column, etag_b: Column, mod_a: Column, mod_b: Column) -> Column:
    """hash, etag or last_modified, the first of which both sides have and differ in; else unchanged."""
    differ = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    return F.when(both(hash_a, hash_b), F.when(differ(hash_a, hash_b), "hash").otherwise("unchanged")).when(differ(etag_a, etag_b), "etag").when(differ(mod_a, mod_b), "last_modified").otherwise("unchanged")


def retry_delay(retry_after: Column, retries: Column) -> Column:
    """Seconds: an integer Retry-After, else 10 doubled each time up to 300."""
    return F.coalesce(retry_after.try_cast("int"), F.least(F.lit(300), (10 * F.pow(F.lit(2), retries)).cast("int")))


#: Values that say nothing.
EMPTY_TITLES = ("n/a", "unknown", "none", "click here", "read more")
NONSENSE = ("n/a", "unknown", "none", "null", "-", "--", "click here", "read more")


def _year(text: Column) -> Column:
    return text.rlike("^[0-9]+$") & F.coalesce(text.try_cast("int").between(1000, 2100), F.lit(False))


def field_plausible(field: Column, value: Column) -> Column:
    """Whether a value can be one of its field: a URL, a date, a year, a title; any text for other fields. Null and empty ones can't."""
    v, f = F.trim(value), F.lower(field)
    ok = F.when(f.endswith("_url"), v.rlike("^(https?://|/)")).when(F.contains(f, F.lit("date")), v.rlike("[0-9]")).when(f.isin("year", "birth_year"), _year(v)).when(f.isin("title", "name"), ~F.lower(v).isin(*EMPTY_TITLES) & (F.length(v) >= 2)).otherwise(True)
    return F.coalesce(F.when(v != "", ok), F.lit(False))


def pattern_valid(field: Column, value: Column) -> Column:
    """Whether a value that is there has the form of its field."""
    v, f = F.trim(value), F.lower(field)
    return F.when(f.endswith("_url"), v.rlike("^(https?://|/)")).when(F.contains(f, F.lit("date")), v.rlike("[0-9]{4}")).when(f.isin("year", "birth_year"), _year(v)).otherwise(F.length(v) > 1)


def nonsensical(field: Column, value: Column) -> Column:
    v = F.lower(F.trim(value))
    return v.isin(*NONSENSE) | (F.lower(field).isin("year", "birth_year") & ~v.rlike("^[0-9]+$")) | (F.length(v) <= 1)


def value_conflict(old: Column, new: Column) -> Column:
    return F.coalesce(present(old) & present(new) & (F.trim(old) != F.trim(new)), F.lit(False))


def image_role(url: Column, alt: Column, context: Column, classes: Column, occurrences: Column) -> Column:
    """(role, confidence, reason) of an image, by the first rule that holds."""
    from loomscan.functions.urls import holds

    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    own, around = F.concat_ws(" ", low(alt), low(classes), low(url)), low(context)
    is_ = lambda role, sure, why: F.struct(F.lit(role).alias("role"), F.lit(sure).alias("confidence"), F.lit(why).alias("reason"))
    return (
        F.when(holds(own, PROFILE_IMAGE), is_("profile", 88, "keyword_profile"))
        .when(holds(own, ARTWORK_IMAGE), is_("artwork", 82, "keyword_artwork"))
        .when(F.contains(around, F.lit("artist")) & F.contains(around, F.lit("photo")), is_("artist_photo", 78, "context_artist_photo"))
        .when(holds(low(classes), TEMPLATE_ZONE), is_("template_shared", 74, "dom_zone_template"))
        .when(holds(own, TEMPLATE_IMAGE), is_("template_shared", 72, "keyword_template"))
        .when(holds(F.concat_ws(" ", own, around), DECORATIVE_IMAGE), is_("decorative", 70, "decorative_context"))
        .when(occurrences > 1, is_("template_shared", 68, "repeated_across_page"))
        .otherwise(is_("unknown", 50, "fallback_unknown"))
    )


def safe_int(value: Column, default: int = 0) -> Column:
    """Whole part of a number in a text; text, NaN and infinite values give the default."""
    d = value.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) >= 9e15), F.lit(default).cast("long")).otherwise(F.floor(d).cast("long"))


def jaccard(left: Column, right: Column) -> Column:
    both = F.size(F.array_union(left, right))
    return F.when(both > 0, F.size(F.array_intersect(left, right)) / both).otherwise(0.0)


def shared_links(left: list[Column], right: list[Column]) -> Column:
    clean = lambda cols: F.filter(F.array(*[F.nullif(c, F.lit("")) for c in cols]), lambda x: x.isNotNull())
    return F.when(F.size(F.array_intersect(clean(left), clean(right))) > 0, 1).otherwise(0)


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)
