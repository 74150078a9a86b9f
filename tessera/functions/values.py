"""Numbers, dates, addresses and identifiers.  Unknown is null, never zero or empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and their short forms.
MONTHS = {name: i for i, names in enumerate(("january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul", "august aug", "september sep sept", "october oct", "november nov", "december dec"), 1) for name in names.split()}


def count_or_null(c: Column) -> Column:
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when((n >= 0) & (n < 9e18), F.coalesce(F.trim(c.cast("string")).try_cast("bigint"), F.floor(n).cast("bigint")))


def year_or_null(c: Column, least: int = 1950) -> Column:
    n = count_or_null(c)
    return F.when(n.between(least, F.year(F.current_date()) + 1), n).cast("int")


def digits_to_int(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"[^\d]", ""), F.lit("")).try_cast("int")


def web_url(c: Column) -> Column:
    """The address if it is http(s) and has a host."""
    part = lambda p: F.try_parse_url(c, F.lit(p))
    return F.when(F.lower(part("PROTOCOL")).isin("http", "https") & (F.length(part("HOST")) > 0), c)


def query_param(c: Column, name: str) -> Column:
    return F.try_parse_url(c, F.lit("QUERY"), F.lit(name))


def last_segment(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def email_domain(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"(?i)Verified email at\s+([\w.\-]+)", 1)), F.lit(""))


def _let(value: Column, body) -> Column:
    """body(value), the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def publication_date(raw: Column, fallback: Column) -> Column:
    """struct(date, year, precision): ISO date at the precision known; an impossible month or day is dropped.

    raw is a column or an expression of built-ins.
    """
    numeric = r"^(\d{4})(?:[/\-.](\d{1,2}))?(?:[/\-.](\d{1,2}))?$"
    month_first = r"^([A-Za-z]+)\.?\s+(?:(\d{1,2}),?\s+)?(\d{4})$"
    day_first = r"^(\d{1,2})\s+([A-Za-z]+)\.?,?\s+(\d{4})$"
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    named = lambda c: F.try_element_at(months, F.lower(c))

    def parts(text: Column) -> Column:
        part = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
        year = F.coalesce(part(numeric, 1), part(month_first, 3), part(day_first, 3)).try_cast("int")
        month = F.coalesce(part(numeric, 2).try_cast("int"), named(part(month_first, 1)), named(part(day_first, 2)))
        day = F.coalesce(part(numeric, 3), part(month_first, 2), part(day_first, 1)).try_cast("int")
        return F.struct(year.alias("y"), F.when(month.between(1, 12), month).alias("m"), day.alias("d"))

    def dated(p: Column) -> Column:
        iso_day = F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"])
        return F.struct(p["y"].alias("y"), p["m"].alias("m"), F.when(p["m"].isNotNull() & p["d"].isNotNull() & iso_day.try_cast("date").isNotNull(), iso_day).alias("iso"), year_or_null(fallback).alias("known"))

    def said(p: Column) -> Column:
        none, whole = p["y"].isNull(), p["iso"].isNotNull()
        date = F.when(none, p["known"].cast("string")).when(p["m"].isNull(), p["y"].cast("string")).when(whole, p["iso"]).otherwise(F.format_string("%04d-%02d", p["y"], p["m"]))
        precision = F.when(none, F.when(p["known"].isNotNull(), "year")).when(p["m"].isNull(), "year").when(whole, "day").otherwise("month")
        return F.struct(date.alias("date"), F.coalesce(p["y"], p["known"]).alias("year"), precision.alias("precision"))

    return _let(_let(_let(F.trim(F.regexp_replace(raw, r"\s+", " ")), parts), dated), said)


def years_agree(a: Column, b: Column, within: int = 0) -> Column:
    return a.isNull() | b.isNull() | (F.abs(a - b) <= within)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def article_id(rank: Column) -> Column:
    return F.format_string("art_%05d", rank)


def person_id(institution_slug: Column, name_slug: Column) -> Column:
    return F.concat_ws("_", F.coalesce(F.nullif(institution_slug, F.lit("")), F.lit("unk")), F.coalesce(F.nullif(name_slug, F.lit("")), F.lit("unknown")))


def external_id_fault(c: Column) -> Column:
    """Why an external id of 12 characters is wrong, or null."""
    return F.when(c.isNull() | (F.trim(c) == ""), "empty").when(F.length(c) != 12, "length").when(~c.rlike("^[A-Za-z0-9_-]{12}$"), "characters")


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.nullif(whole, F.lit(0)), 1)


def words_from_index(index: Column) -> Column:
    """The text of an inverted index: map of word to positions; at a position claimed twice the later word wins."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    ordered = F.array_sort(entries)
    last = F.filter(ordered, lambda e, k: (k + 1 == F.size(ordered)) | (F.try_element_at(ordered, (k + 2).cast("int"))["p"] != e["p"]))
    return F.nullif(F.array_join(F.transform(last, lambda e: e["w"]), " "), F.lit(""))


def scaled_round(x: Column, places: int) -> Column:
    """x rounded as SQL engines on doubles do: the product with 10^places to whole numbers, ties away from zero.

    Spark's round looks at the shortest decimals instead: 0.5115 gives 0.512 there and 0.511 here, as 0.5115 * 1000 is below 511.5.
    """
    return F.round(x.cast("double") * 10.0**places, 0) / 10.0**places
