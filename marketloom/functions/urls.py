"""URL canonical form, domain and domain classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom import fixed

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#;]*)(?:;[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, index)


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """Lower-case host, no fragment, no tracking parameters, sorted query, no trailing slash."""
    scheme, path = F.lower(_part(url, 1)), _part(url, 3)
    pairs = F.transform(
        F.split(_part(url, 4), "&"),
        lambda p: F.struct(
            _decode(F.regexp_extract(p, r"^([^=]*)=", 1)).alias("k"),
            _decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(fixed.TRACKING_PARAMS))
    query = F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )
    trimmed = F.regexp_replace(path, "/+$", "")
    return F.concat(
        F.when(scheme == "", F.lit("https")).otherwise(scheme),
        F.lit("://"),
        F.lower(_part(url, 2)),
        F.when((path == "") | (path == "/"), F.lit("/")).otherwise(trimmed),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(_part(url, 2)), "^www[.]", "")


def host_suffixes(host: Column) -> Column:
    """The host and every dotted suffix of it, longest first."""
    labels = F.split(host, "[.]")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def source_type(host: Column, domains: dict[str, str] | None = None) -> Column:
    """Type of the first listed domain the host equals or ends with; media otherwise."""
    kind = F.when(F.coalesce(host, F.lit("")) == "", "unknown").otherwise("media")
    for listed, known in reversed((domains or fixed.SOURCE_TYPE_BY_DOMAIN).items()):
        kind = F.when((host == listed) | F.endswith(host, F.lit(f".{listed}")), known).otherwise(kind)
    return kind
