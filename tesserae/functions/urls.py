"""Column functions on URLs, hosts, addresses and content identities."""

import ipaddress
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by content type.
IMAGE_EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp"}
VIDEO_EXTENSIONS = {"video/mp4": ".mp4", "video/quicktime": ".mov", "video/webm": ".webm", "video/x-msvideo": ".avi", "video/3gpp": ".3gp"}

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)(?::([0-9]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def hostname(url: Column) -> Column:
    """The host in lower case, without user, port or brackets; '' where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _PARTS, 2)), r"^\[|\]$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3).try_cast("int")


def canonical_host(url: Column) -> Column:
    """The key of a host's budget: a port shows unless it is the scheme's own."""
    own = F.when(scheme(url) == "http", 80).when(scheme(url) == "https", 443)
    p = port(url)
    return F.when(p.isNotNull() & ~p.eqNullSafe(own), F.concat_ws(":", hostname(url), p.cast("string"))).otherwise(hostname(url))


def canonical_origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), canonical_host(url))


def host_header(url: Column) -> Column:
    return F.when(hostname(url) == "", "").when(port(url) > 0, F.concat_ws(":", hostname(url), port(url).cast("string"))).otherwise(hostname(url))


def robots_url(url: Column) -> Column:
    return F.concat(canonical_origin(url), F.lit("/robots.txt"))


def is_fetchable(url: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(scheme(url).isin("http", "https") & (hostname(url) != ""), F.lit(False))


def same_host(a: Column, b: Column) -> Column:
    """Whether a redirect from one to the other stays on its host."""
    return canonical_host(a) == canonical_host(b)


def resolved(base: Column, target: Column) -> Column:
    """A redirect target against the page that named it."""

    @F.pandas_udf("string")
    def run(bases: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or t is None else urljoin(b, t) for b, t in zip(bases, targets, strict=True)], dtype=object)

    return run(base, target)


def is_public(address: Column) -> Column:
    """Whether an IP address is neither private, loopback, link-local, reserved, multicast nor unspecified; text that is no address is not."""

    @F.pandas_udf("boolean")
    def run(addresses: pd.Series) -> pd.Series:
        def one(a):
            try:
                ip = ipaddress.ip_address(a)
            except ValueError:
                return False
            return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)

        return addresses.map(one).astype(bool)

    return run(address)


def is_text(content_type: Column) -> Column:
    kind = F.trim(F.lower(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.coalesce(kind.startswith("text/") | (kind == "application/xhtml+xml"), F.lit(False))


def url_key(url: Column) -> Column:
    """The media cache's key."""
    return F.md5(url)


def content_path(sha: Column, extension: str = ".html") -> Column:
    return F.concat(F.lit("captures/"), sha, F.lit(extension))


def extension(content_type: Column, media_type: Column) -> Column:
    """The file extension of a medium, .mp4 or .jpg where its type is not known."""
    pick = lambda known, default: F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.lower(content_type)], F.lit(default))
    return F.when(media_type == "video", pick(VIDEO_EXTENSIONS, ".mp4")).otherwise(pick(IMAGE_EXTENSIONS, ".jpg"))
