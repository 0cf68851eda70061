"""Addresses, handles and times as the two sites write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Addresses of posts and home feeds.
X_POST = r"^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/([A-Za-z0-9_]{1,15})/status/(\d+)(?:[/?#].*)?$"
X_HOME = r"^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/?(?:home/?)?(?:[?#].*)?$"
LINKEDIN_HOME = r"^https?://(?:www\.)?linkedin\.com/(?:feed/?)?(?:[?#].*)?$"
LINKEDIN_POST = (
    r"^https?://(?:www\.)?linkedin\.com/(feed/update/urn:li:(?:activity|ugcPost|share):\d+"
    r"|posts/[^/?#]*-(?:activity|ugcPost|share)-\d+[^/?#]*)/?(?:[?#].*)?$"
)
LOGIN = [
    r"/i/flow/login", r"^https://(www\.)?(x|twitter)\.com/login", r"linkedin\.com/authwall", r"linkedin\.com/login",
    r"linkedin\.com/uas/login", r"linkedin\.com/checkpoint",
]
RELATIVE = r"(?i)^(\d+)\s*(mo|yr|s|m|h|d|w|y)"
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "mo": 2592000, "yr": 31536000, "y": 31536000}


def target(url: Column) -> Column:
    """struct(site, url, feed) of a supported address in its canonical form; null for any other."""
    u = F.trim(F.coalesce(url, F.lit("")))

    def made(site: str, to: Column, feed: bool) -> Column:
        return F.struct(F.lit(site).alias("site"), to.alias("url"), F.lit(feed).alias("feed"))

    x_url = F.concat(F.lit("https://x.com/"), F.regexp_extract(u, X_POST, 1), F.lit("/status/"), F.regexp_extract(u, X_POST, 2))
    l_url = F.concat(F.lit("https://www.linkedin.com/"), F.regexp_extract(u, LINKEDIN_POST, 1), F.lit("/"))
    return (
        F.when(u.rlike(X_HOME), made("X", F.lit("https://x.com/home"), True))
        .when(u.rlike(LINKEDIN_HOME), made("LinkedIn", F.lit("https://www.linkedin.com/feed/"), True))
        .when(u.rlike(X_POST), made("X", x_url, False))
        .when(u.rlike(LINKEDIN_POST), made("LinkedIn", l_url, False))
    )


def login_required(url: Column) -> Column:
    return url.rlike("|".join(f"(?:{p})" for p in LOGIN))


def handle(href: Column) -> Column:
    """/in/x gives x, /company/y gives company-y, decoded; null for other links."""
    person, company = F.regexp_extract(href, r"/in/([^/?#]+)", 1), F.regexp_extract(href, r"/company/([^/?#]+)", 1)

    def decoded(c: Column) -> Column:
        return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)

    return F.when(person != "", decoded(person)).when(company != "", F.concat(F.lit("company-"), decoded(company)))


def created_at(item_id: Column, relative: Column, now: Column) -> Column:
    """The time in an id's high bits if it lies between 2012 and tomorrow; else now less a label like 3h; else now."""
    ms = F.shiftright(item_id.try_cast("long"), 22)
    own = F.timestamp_millis(ms)
    fine = (own > F.timestamp_seconds(F.lit(1325376000))) & (own < now + F.expr("INTERVAL 1 DAY"))
    n, unit = F.regexp_extract(F.trim(relative), RELATIVE, 1), F.lower(F.regexp_extract(F.trim(relative), RELATIVE, 2))
    seconds = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])[unit]
    back = F.timestamp_micros(F.unix_micros(now) - F.when(n != "", n.cast("long") * seconds).otherwise(0) * 1_000_000)
    return F.when(fine, own).otherwise(F.when(relative.isNotNull(), back).otherwise(now))


def pseudonym(account_id: Column) -> Column:
    """A stable short name: FNV-1a over UTF-16 units, as four base-36 digits at least."""
    from choralis.sources.names import fnv_name

    return fnv_name(account_id)
