"""Format checks as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regulith.functions.text import strip
from regulith.session import col

# Formats of checksums, trace ids and repeating intervals.
SHA256 = "^[0-9a-f]{64}$"
TRACE = "^([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{16}|[0-9a-f]{32})$"
CADENCE = r"^(R/\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z/)?P(\d+Y)?(\d+M)?(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?$"


def _check(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def is_sha256(c: Column | str) -> Column:
    return _check(F.lower(strip(c)), SHA256)


def is_trace_id(c: Column | str) -> Column:
    return _check(F.lower(strip(c)), TRACE)


def _labels_valid(labels: Column) -> Column:
    """Host labels of 1 to 63 letters, digits and hyphens, without a hyphen at either end."""
    return F.forall(labels, lambda x: F.length(x).between(1, 63) & ~x.rlike("[^A-Za-z0-9-]") & ~x.startswith("-") & ~x.endswith("-"))


def _host_name(host: Column, longest_top: int) -> Column:
    """Two labels or more, the last of them letters only."""
    labels = F.split(host, r"\.", -1)
    top = F.element_at(labels, -1)
    return (F.size(labels) >= 2) & _labels_valid(labels) & F.length(top).between(2, longest_top) & ~top.rlike("[^A-Za-z]")


def is_domain(c: Column | str) -> Column:
    return F.coalesce(_host_name(col(c), 63), F.lit(False))


def is_url(c: Column | str) -> Column:
    """http or https, a host name (or localhost, or four numbers), maybe a port, maybe a path or query without blanks."""
    text = F.lower(strip(c))
    rest = F.substring_index(text, "://", -1)
    scheme = F.substring_index(text, "://", 1)
    place = F.regexp_extract(rest, "^[^/?]*", 0)
    tail = F.substr(rest, F.length(place) + 1)
    host = F.regexp_replace(F.substring_index(place, ":", 1), r"\.$", "")
    port = F.when(F.contains(place, F.lit(":")), F.substr(place, F.length(F.substring_index(place, ":", 1)) + 2))
    numbers = F.split(F.substring_index(place, ":", 1), r"\.", -1)
    four = (F.size(numbers) == 4) & F.forall(numbers, lambda x: F.length(x).between(1, 3) & ~x.rlike("[^0-9]"))
    valid = (
        scheme.isin("http", "https") & (F.length(text) == F.length(scheme) + 3 + F.length(rest))
        & (_host_name(host, 6) | (F.substring_index(place, ":", 1) == "localhost") | four)
        & (port.isNull() | (port.rlike("^[0-9]+$"))) & ~tail.rlike(r"\s") & (tail != "?")
    )
    return F.coalesce(valid, F.lit(False))


def is_cadence(c: Column | str) -> Column:
    """A duration (P, days part, T, time part), maybe after a repeat mark and a start time."""
    return _check(col(c), CADENCE)


def errors(**rules: Column) -> Column:
    """Codes of the violated rules, in declaration order: array<string>."""
    labelled = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()])
    return F.filter(labelled, lambda e: e.isNotNull())
