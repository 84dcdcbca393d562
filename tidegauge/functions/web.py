"""Column functions on request targets: endpoint, route template, latency heuristic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the latency heuristic: (path words, base milliseconds), first match wins.
LATENCY_BASES = [
    (["image", "images", "img", "media", "static", "productmodel", "article"], 55),
    (["search", "filter", "category", "products", "product"], 140),
    (["login", "auth", "signin", "register"], 260),
    (["cart", "basket", "profile", "account"], 190),
    (["orders", "order", "checkout", "payment"], 900),
    (["admin", "users", "user"], 320),
]
OTHER_BASE = 120
BOT_SIGNATURES = ["bot", "crawler", "spider", "ahrefs", "bingbot", "googlebot", "python-requests", "curl/", "wget", "sqlmap"]


def normalize_endpoint(target: Column) -> Column:
    """Path of a request target, percent-decoded, with a slash before it.

    Scheme, host, query and fragment go; a target without a path stays whole.  An escape
    that is none stays as it is.
    """
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(target, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"^//[^/?#]*", ""), r"[?#].*$", "")
    path = F.when(path == "", target).otherwise(path)
    escaped = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    plain = F.coalesce(F.try_url_decode(escaped), path)
    return F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit("/"), plain))


def route_template(endpoint: Column) -> Column:
    """The endpoint with {size} for 12x34 and {id} for numbers and long hexadecimal segments."""

    def named(x: Column) -> Column:
        return F.when(x.rlike(r"^\d+[xX]\d+$"), F.lit("{size}")).when(x.rlike(r"^\d+$|^[0-9a-fA-F-]{8,}$"), F.lit("{id}")).otherwise(x)

    parts = F.split(F.regexp_replace(endpoint, "^/+|/+$", ""), "/")
    return F.when(endpoint == "/", endpoint).otherwise(F.concat(F.lit("/"), F.array_join(F.transform(parts, named), "/")))


def infer_latency_ms(endpoint: Column, status: Column, user_agent: Column) -> Column:
    """A plausible latency for a log line that has none; equal lines get equal values."""
    tokens = F.array_distinct(F.filter(F.split(F.lower(endpoint), "/"), lambda x: x != ""))
    base = F.lit(OTHER_BASE)
    for words, ms in reversed(LATENCY_BASES):
        base = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), F.lit(ms)).otherwise(base)
    base = base + F.when(status >= 500, 1700).when(status == 429, 350).when(status >= 400, 140).otherwise(0)
    signed = F.lower(user_agent).rlike("|".join(BOT_SIGNATURES))
    base = F.when(signed & (status < 500), F.greatest(F.lit(35), base - 25)).otherwise(base)
    digest = F.sha1(F.encode(F.concat_ws("|", endpoint, status.cast("string"), user_agent), "UTF-8"))
    jitter = F.conv(F.substring(digest, 1, 6), 16, 10).cast("int") % 180
    return (base + F.greatest(F.lit(0), F.size(tokens) - 2) * 12 + jitter).cast("int")
