"""How titles, pages and routes are shown, and how large a page's record is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: bytes of a page record before its links and title.
RECORD_HEADER_BYTES = 16


def quote(title: Column) -> Column:
    return F.concat(F.lit('"'), title, F.lit('"'))


def route_string(route: Column) -> Column:
    """Quoted titles joined by arrows; what a route without nodes says is that there is none."""
    return F.when(F.size(route) > 0, F.array_join(F.transform(route, quote), " -> ")).otherwise(F.lit("No route found"))


def page_string(title: Column, page_id: Column, links: Column) -> Column:
    return F.concat(quote(title), F.lit(" (#"), page_id.cast("string"), F.lit("), "), F.size(links).cast("string"), F.lit(" links"))


def title_bytes(title: Column) -> Column:
    return F.octet_length(title)


def record_size(title: Column, links: Column) -> Column:
    return F.lit(RECORD_HEADER_BYTES) + 4 * F.size(links) + F.octet_length(title)
