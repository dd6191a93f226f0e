"""Column expressions shared by the operators."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Icon shown for a category without an image.
CATEGORY_ICONS = {
    "Video_Games": "🎮",
    "Digital_Music": "🎵",
    "Software": "💻",
    "Electronics": "📱",
    "Clothing": "👕",
    "Books": "📚",
    "Home": "🏠",
    "Garden": "🌱",
    "Sports": "⚽",
    "Beauty": "💄",
    "Appliances": "🔌",
    "Gift_Cards": "🎁",
    "Industrial": "🏭",
    "Magazine": "📰",
    "Pantry": "🥫",
}
DEFAULT_ICON = "📦"

# Texts of an explanation and the bounds that call for them.
SAYS_CATEGORY = "Matches your interest in "
SAYS_CHEAP = "Good value for money"
SAYS_PREMIUM = "Premium quality product"
SAYS_RATED = "Highly rated (%.1f/5.0)"
SAYS_POPULAR = "Popular among customers"
SAYS_NOTHING = "Recommended based on your preferences"
CHEAP_SENSITIVITY, CHEAP_PRICE = 0.7, 50
PREMIUM_SENSITIVITY, PREMIUM_PRICE = 0.3, 200
GOOD_RATING, GOOD_POPULARITY = 4.0, 10


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """Stable bucket 0..buckets-1 from the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets


def seeded_order(seed: int | Column, key: Column) -> Column:
    """A sort key that shuffles rows the same way for the same seed."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is missing or has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def shorten(text: Column, limit: int) -> Column:
    """Cut a display title and mark the cut with dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("...")))\
        .otherwise(text)


def stars(rating: Column) -> Column:
    return F.repeat(F.lit("⭐"), rating.cast("int"))


def price_label(price: Column) -> Column:
    return F.format_string("$%.2f", price)


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def image_or_icon(urls: Column, category: Column) -> Column:
    """First image if it is a web address, else the icon of the category."""
    first = F.get(urls, F.lit(0))
    icons = F.create_map(*[F.lit(x) for pair in CATEGORY_ICONS.items() for x in pair])
    return F.when(is_web_url(first), first).otherwise(
        F.coalesce(F.try_element_at(icons, category), F.lit(DEFAULT_ICON)))


def parse_image_list(text: Column) -> Column:
    """List of image addresses from JSON or from a printed numpy array."""
    as_json = F.from_json(text, "array<string>")
    quoted = F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1))
    return (F.when(~F.coalesce(F.ltrim(text).startswith("["), F.lit(False)),
                   F.when(F.length(F.trim(text)) > 0, F.array(text)))
            .when(as_json.isNotNull(), as_json)
            .when(F.size(quoted) > 0, quoted))


def explain_recommendation(
    favorite: Column, sensitivity: Column, category: Column, price: Column,
    avg_rating: Column, popularity: Column,
) -> Column:
    """Why an item was recommended, as one line of text."""
    parts = F.concat_ws(
        " | ",
        F.when((favorite != "") & (favorite == category),
               F.concat(F.lit(SAYS_CATEGORY), category)),
        F.when((sensitivity > CHEAP_SENSITIVITY) & (price < CHEAP_PRICE), SAYS_CHEAP)
        .when((sensitivity < PREMIUM_SENSITIVITY) & (price > PREMIUM_PRICE), SAYS_PREMIUM),
        F.when(avg_rating > GOOD_RATING, F.format_string(SAYS_RATED, avg_rating)),
        F.when(popularity > GOOD_POPULARITY, SAYS_POPULAR),
    )
    return F.when(parts == "", SAYS_NOTHING).otherwise(parts)


def result_key(prefix: str, identifier: Column, params: Mapping[str, object] | None = None) -> Column:
    """``prefix:identifier:hash`` where the hash covers the sorted parameters.

    The hashed text is JSON with ", " and ": " between its parts; a parameter
    may be a constant or a string column.
    """
    parts = [F.lit(prefix), identifier.cast("string")]
    if params:
        pieces: list[Column] = []
        for i, name in enumerate(sorted(params)):
            value = params[name]
            opening = ("{" if i == 0 else ", ") + json.dumps(name) + ": "
            text = (_json_text(value) if isinstance(value, Column) else F.lit(json.dumps(value)))
            pieces += [F.lit(opening), text]
        joined = F.concat(*pieces, F.lit("}"))
        parts.append(F.substring(F.md5(joined), 1, 8))
    return F.concat_ws(":", *parts)


def _json_text(value: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def plain_key(prefix: str, *parts: Column, **named: object) -> Column:
    """``prefix:part:...:name=value`` with the names sorted."""
    named_parts = [
        F.concat(F.lit(f"{k}="), v.cast("string") if isinstance(v, Column) else F.lit(str(v)))
        for k, v in sorted(named.items())
    ]
    return F.concat_ws(":", F.lit(prefix), *[p.cast("string") for p in parts], *named_parts)
