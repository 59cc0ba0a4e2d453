"""Column functions: text and markup helpers, URL helpers and guarded arithmetic. All stay inside Catalyst."""

from __future__ import annotations

import math
from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.references import decoded

#: Fixed value: white space as text has it, no-break and other spaces beyond ASCII included.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TAG = "<[^>]+>"
#: Rating tokens of list addresses. Fixed values.
STAR_TOKENS = {"1/2": 0.5, "%C2%BD": 0.5, "1": 1.0, "1%C2%BD": 1.5, "2": 2.0, "2%C2%BD": 2.5, "3": 3.0, "3%C2%BD": 3.5, "4": 4.0, "4%C2%BD": 4.5, "5": 5.0}
#: References that tables of pages are written with, the ampersand's last. Fixed values.
PLAIN_REFERENCES = {"&quot;": '"', "&lt;": "<", "&gt;": ">", "&copy;": "©", "&middot;": "·", "&nbsp;": "\u00a0", "&#39;": "'", "&apos;": "'", "&amp;": "&"}
ROUTES = (("/rss/", "rss"), ("/reviews/", "reviews"), ("/following/", "people"), ("/followers/", "people"), ("/films/", "films"), ("/film/", "film_ids"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def pages_for(n: Column, per_page: int) -> Column:
    return F.ceil(n / per_page).cast("long")


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", ""), F.lit(""))


def separated_int(x: Column) -> Column:
    """Integers with thousands separators or no-break spaces between digits; anything else is null."""
    return F.regexp_replace(x, r"[,\s ]|&nbsp;", "").try_cast("bigint")


def glyph_rating(x: Column) -> Column:
    """Stars and a half, wherever they stand; null without any."""
    stars = F.length(F.regexp_replace(x, "[^★]", "")) + F.when(F.contains(x, F.lit("½")), 0.5).otherwise(0.0)
    return F.when(stars > 0, stars)


def title_rating(x: Column) -> Column:
    """Stars that end a title; null without any."""
    stars = F.length(F.regexp_extract(x, r"(★+)(½)?\s*$", 1))
    half = F.when(F.regexp_extract(x, r"(★+)(½)?\s*$", 2) == "½", 0.5).otherwise(0.0)
    return F.when(stars > 0, stars + half)


def slug_of(link: Column) -> Column:
    return F.nullif(F.regexp_extract(link, "/film/([^/]+)/", 1), F.lit(""))


def plainly_decoded(x: Column) -> Column:
    """Only ``PLAIN_REFERENCES`` are decoded, each with its semicolon: one that was cut off stays as it stands."""
    for reference, text in PLAIN_REFERENCES.items():
        x = F.replace(x, F.lit(reference), F.lit(text))
    return x


def stripped(x: Column, decode: Callable[[Column], Column] = decoded) -> Column:
    """Text of markup: tags become spaces, references are decoded after that, white space is collapsed."""
    return without_spaces(decode(F.regexp_replace(x, TAG, " ")))


def without_spaces(x: Column) -> Column:
    """White space collapsed, and none at the ends."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def route_of(url: Column, status: Column) -> Column:
    """Kind of page: the first route that the address holds."""
    kind = F.when(~status.between(200, 299) | status.isNull(), "non200")
    for part, name in ROUTES:
        kind = kind.when(F.contains(url, F.lit(part)), name)
    return kind.otherwise("other")


def stars_of_url(url: Column) -> Column:
    """Rating that a list address names by a token; unknown tokens are null."""
    tokens = F.create_map(*[F.lit(x) for pair in STAR_TOKENS.items() for x in pair])
    return F.try_element_at(tokens, F.regexp_extract(url, "/rated/([^/]+(?:/2)?)/", 1))


def paged(base: Column, page: Column) -> Column:
    """Address of a page of a list; the first page has no suffix."""
    return F.concat(base, F.when(page == 1, F.lit("")).otherwise(F.concat(F.lit("page/"), page.cast("string"), F.lit("/"))))


#: Addresses by kind; the first page of a list has no suffix. Fixed values.
ADDRESSES = {
    "feed": "/{user}/rss/",
    "films": "/{user}/films/{page}",
    "following": "/{user}/following/{page}",
    "followers": "/{user}/followers/{page}",
    "film": "/film/{film}/",
    "reviews": "/film/{film}/reviews/by/{sort}/",
    "histogram": "/csi/film/{film}/rating-histogram/",
    "friends": "/{user}/friends/film/{film}/",
    "rated": "/film/{film}/members/rated/{stars}/{page}",
    "members": "/film/{film}/members/{page}",
    "likes": "/film/{film}/likes/{page}",
}


def address(kind: str, base: str, **parts: Column) -> Column:
    """Address of a page; ``parts`` fill in its kind's names: user, film, sort, stars (a rating) and page (a number)."""
    tokens = F.create_map(*[F.lit(x) for token, stars in STAR_TOKENS.items() if token != "1/2" for x in (stars, token)])
    if "stars" in parts:
        parts["stars"] = F.try_element_at(tokens, parts["stars"].cast("double"))
    if "page" in parts:
        parts["page"] = paged(F.lit(""), parts["page"])
    pieces = [x for text, name, *_ in Formatter().parse(ADDRESSES[kind]) for x in (F.lit(text), parts[name].cast("string") if name else None) if x is not None]
    return F.concat(F.lit(base), *pieces)


def sha_shard(x: Column, shards: int) -> Column:
    """The whole SHA-256 digest as a number, modulo ``shards``."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substr(F.sha2(x.cast("binary"), 256), i, F.lit(1)), 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % shards)


def ln_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series, shifted by ten for small n."""
    x = n.cast("double") + 11.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    shift = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0.0), lambda a, k: a + F.ln(n.cast("double") + k))
    return series - shift


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def six(x: Column) -> Column:
    return F.round(x, 6)
