"""Rows from positioned words: columns by as-of, rows by nearest number, lines by an ordered fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import clean_light, join_wrapped, light_cells, match_key, match_keys, name_key, person_name, slug
from tessera.functions.values import person_id

LINE, COLUMN, ROW = 3.0, 3.0, 45.0


def lines(words: Column) -> Column:
    """Array of lines (arrays of text) from an array of (text, x0, top, bottom).

    A word joins the line while its centre is within 3 points of the centre of the line's first word.
    """
    entry = "struct<mid:double,words:array<struct<x0:double,text:string>>>"
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(w["top"].alias("top"), w["x0"].alias("x0"), w["bottom"].alias("bottom"), w["text"].alias("text"))))

    def add(acc: Column, w: Column) -> Column:
        mid = (w["top"] + w["bottom"]) / 2
        last = F.try_element_at(acc, F.lit(-1))
        one = F.array(F.struct(w["x0"].alias("x0"), w["text"].alias("text")))
        joins = F.coalesce(F.abs(last["mid"] - mid) <= LINE, F.lit(False))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["mid"].alias("mid"), F.concat(last["words"], one).alias("words"))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(F.struct(mid.alias("mid"), one.alias("words")))))

    folded = F.aggregate(ordered, F.array().cast(f"array<{entry}>"), add)
    return F.transform(folded, lambda line: F.array_join(F.transform(F.array_sort(line["words"]), lambda w: w["text"]), " "))


def table_rows(words: DataFrame, columns: DataFrame) -> DataFrame:
    """(page, row_number, name, value) from words (page, text, x0, top, bottom) and columns (page, name, start).

    The column is the last that starts at or before x0 + 3; numbers in the first column are the rows' anchors,
    and a word belongs to the nearest within 45 points, the first of equals.  Words of icon glyphs alone are left out.
    """
    icons = f"^[{chr(0xE000)}-{chr(0xF8FF)}]+$"
    per_page = columns.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("start", "name"))).alias("_cols"))
    placed = words.where(~F.col("text").rlike(icons)).join(per_page, "page")
    placed = placed.withColumn("_c", F.try_element_at(F.filter("_cols", lambda c: c["start"] <= F.col("x0") + COLUMN), F.lit(-1))["name"]).where("_c is not null").withColumn("mid", (F.col("top") + F.col("bottom")) / 2)
    number = (F.col("_c") == F.element_at("_cols", 1)["name"]) & F.col("text").rlike(r"^\d+$")
    anchors = placed.where(number).groupBy("page").agg(F.collect_list(F.struct("mid", F.col("text").cast("int").alias("number"))).alias("_rows"))
    near = placed.where(~number).join(anchors, "page").withColumn("_a", F.array_min(F.transform("_rows", lambda a: F.struct(F.abs(a["mid"] - F.col("mid")).alias("d"), a["number"].alias("number")))))
    kept = near.where(F.col("_a.d") <= ROW)
    cell = kept.groupBy("page", F.col("_a.number").alias("row_number"), F.col("_c").alias("name")).agg(F.collect_list(F.struct("text", "x0", "top", "bottom")).alias("w"))
    return cell.select("page", "row_number", "name", join_wrapped(lines(F.col("w"))).alias("value"))


def sequence_gaps(rows: DataFrame, number: str, declared: Column | None = None) -> DataFrame:
    """Numbers missing between 1 and the greatest (or declared) one."""
    top = rows.agg(F.coalesce(declared, F.max(number)).cast("int").alias("n"))
    return top.select(F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))).alias(number)).join(rows.select(number), number, "left_anti")


def split_text_rows(lines_df: DataFrame, line: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows with as many cells as the header, the other lines): cells part at two spaces or a tab."""
    cells = lines_df.withColumn("cells", F.split(F.trim(line), r"\s{2,}|\t"))
    return cells.where(F.size("cells") == width), cells.where(F.size("cells") != width)


def carried_header(rows: DataFrame, is_header: Column, mapping: Column, order: str, page: str) -> DataFrame:
    """The header mapping in force at each row, carried across pages; null before the first.

    Within a page it is the last header before the row, else the last of the pages before; only headers, a row a page,
    are ordered in one place.
    """
    own = W.partitionBy(page).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    here = rows.withColumn("_own", F.last(F.when(is_header, mapping), ignorenulls=True).over(own))
    last = rows.where(is_header).groupBy(page).agg(F.max_by(mapping, order).alias("_m"))
    pages = rows.select(page).distinct().join(last, page, "left")
    before = F.last("_m", ignorenulls=True).over(W.orderBy(page).rowsBetween(W.unboundedPreceding, -1))
    carried = pages.select(F.col(page).alias("_page"), before.alias("_before"))
    return here.join(carried, F.col(page) == F.col("_page"), "left").withColumn("mapping", F.coalesce("_own", "_before")).drop("_own", "_before", "_page")


#: Spellings of the columns in a header row, words of the header line and of the footer.
ALIASES = {"etablissement": ("etablissement", "etab", "institution"), "chercheur_source_name": ("enseignant chercheur", "enseignant", "chercheur", "nom et prenom", "nom prenom", "nom", "membre"), "laboratoire": ("laboratoire", "labo", "structure de recherche"), "equipe": ("equipe", "equipe de recherche"), "type_membre": ("type membre", "type de membre", "type", "statut")}
HEADER_WORDS = {"#": "index", "etablissement": "etablissement", "enseignant": "chercheur_source_name", "laboratoire": "laboratoire", "equipe": "equipe", "type": "type_membre"}
FOOTER_WORDS = ("exporter", "records")
NAME, TOTAL = "chercheur_source_name", r"Records\s*:\s*\d+\s*sur\s*(\d+)"


def header_mapping(cells: Column) -> Column:
    """Map of column index to field for the cells' matching keys, if they are a header: the name and another field.

    The first cell of a field counts.
    """
    names = F.create_map(*[F.lit(x) for field, keys in ALIASES.items() for key in keys for x in (key, field)])
    fields = F.transform(cells, lambda c: F.try_element_at(names, c))
    pairs = F.filter(F.transform(fields, lambda f, k: F.struct(k.alias("k"), f.alias("f"))), lambda p: p["f"].isNotNull() & (F.array_position(fields, p["f"]) == p["k"] + 1))
    return F.when(F.array_contains(fields, NAME) & (F.size(pairs) >= 2), F.map_from_entries(pairs))


def rows_to_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, skipped rows with a reason) of table rows (page, pos, cells).

    A header row sets the mapping of what follows, on later pages too.  Rows before the first header are skipped as
    no_header_yet, rows without a name as empty_name.
    """
    mapped = rows.withColumn("_keys", match_keys(F.col("cells"))).withColumn("_h", header_mapping(F.col("_keys")))
    carried = carried_header(mapped, F.col("_h").isNotNull(), F.col("_h"), "pos", "page").where(F.col("_h").isNull())
    clean = light_cells(F.col("cells"))
    at = lambda field: F.try_element_at(F.filter(F.map_entries("mapping"), lambda e: e["value"] == field), F.lit(1))["key"]
    told = carried.withColumn("_cells", clean)
    told = told.withColumns({f: F.try_element_at("_cells", at(f) + 1) for f in ALIASES})
    reason = F.when(F.col("mapping").isNull(), "no_header_yet").when(F.col(NAME).isNull(), "empty_name")
    judged = told.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).select("page", "pos", *ALIASES), judged.where(F.col("reason").isNotNull()).select("page", "pos", "reason", "cells")


def text_rows(lines_df: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(table rows, unparsed lines) of text lines (page, pos, line): a line is a row if it is a header or has as many cells
    as the header in force has fields."""
    cells = F.filter(F.transform(F.split(F.trim(line), r"\s{2,}|\t"), lambda c: F.trim(c)), lambda c: c != "")
    split = lines_df.where(F.length(F.trim(line)) > 0).withColumn("cells", cells)
    mapped = split.withColumn("_keys", match_keys(F.col("cells"))).withColumn("_h", header_mapping(F.col("_keys")))
    carried = carried_header(mapped, F.col("_h").isNotNull(), F.col("_h"), "pos", "page")
    fits = F.col("_h").isNotNull() | F.coalesce(F.size("cells") == F.size("mapping"), F.lit(False))
    return carried.where(fits).select("page", "pos", "cells"), carried.where(~fits).select("page", "pos", F.array_join("cells", " | ").alias("line"))


def locate_header(words: DataFrame) -> DataFrame:
    """(page, name, start, bottom) of the columns of each page's header: the line of the first word `etablissement` within 3
    points of which a number sign and a name column stand; of several words for a column the first counts.

    words: page, pos (their order), text, key (matching key), x0, top, bottom.
    """
    names = F.create_map(*[F.lit(x) for pair in HEADER_WORDS.items() for x in pair])
    name = F.when(F.col("text") == "#", "index").otherwise(F.try_element_at(names, F.col("key")))
    known = words.withColumn("name", name)
    anchors = known.where(F.col("key") == "etablissement").select("page", F.col("pos").alias("_a"), F.col("top").alias("_top"))
    near = known.join(anchors, "page").where(F.abs(F.col("top") - F.col("_top")) < LINE)
    line = near.groupBy("page", "_a").agg(F.max("bottom").alias("bottom"), F.collect_set("name").alias("names"))
    first = line.where(F.array_contains("names", "index") & F.array_contains("names", NAME)).groupBy("page").agg(F.min("_a").alias("_a"))
    kept = near.join(first, ["page", "_a"]).join(line.select("page", "_a", F.col("bottom").alias("_b")), ["page", "_a"])
    return kept.where("name is not null").groupBy("page", "name").agg(F.min_by("x0", "pos").alias("start"), F.max("_b").alias("bottom"))


def page_body(words: DataFrame, header: DataFrame) -> DataFrame:
    """The words between a page's header and its footer, none left of the first column."""
    edge = header.groupBy("page").agg(F.max("bottom").alias("_low"), F.min("start").alias("_left"))
    placed = words.join(edge, "page")
    footer = placed.where(F.col("key").isin(*FOOTER_WORDS) & (F.col("top") > F.col("_low"))).groupBy("page").agg(F.min("top").alias("_foot"))
    inside = (F.col("top") > F.col("_low") - 1) & (F.col("_foot").isNull() | (F.col("top") < F.col("_foot"))) & (F.col("x0") >= F.col("_left") - COLUMN)
    return placed.join(footer, "page", "left").where(inside).drop("_low", "_left", "_foot")


def words_to_records(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, skipped) of the word boxes of pages: header, body, columns, rows and cells."""
    keyed = words.withColumn("key", match_key(F.col("text")))
    header = locate_header(keyed)
    cells = table_rows(page_body(keyed, header), header.select("page", "name", "start"))
    wide = cells.groupBy("page", "row_number").agg(*[F.max(F.when(F.col("name") == f, F.col("value"))).alias(f) for f in ALIASES])
    light = wide.withColumns({f: clean_light(F.col(f)) for f in ALIASES})
    return light.where(F.col(NAME).isNotNull()), light.where(F.col(NAME).isNull()).select("page", F.col("row_number").cast("string").alias("row"), F.lit("empty_name").alias("reason"))


def declared_total(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row, expected_rows: the total that the last page naming one declares."""
    found = pages.select("page", F.nullif(F.regexp_extract(text, TOTAL, 1), F.lit("")).try_cast("int").alias("n"))
    return found.agg(F.max_by("n", F.when(F.col("n").isNotNull(), F.col("page"))).alias("expected_rows"))


def sequence_warnings(records: DataFrame, total: DataFrame, number: str = "row_number") -> DataFrame:
    """(warning, n): row numbers that are missing or repeated, and a count other than the declared one."""
    one = records.agg(F.count(number).alias("n"), F.countDistinct(number).alias("d"), F.coalesce(F.max(number), F.lit(0)).alias("most")).join(total)
    said = F.array_compact(F.array(F.when((F.col("d") != F.col("n")) | (F.col("most") != F.col("n")), F.struct(F.lit("numbers missing or repeated").alias("warning"), (F.col("most") - F.col("d")).cast("long").alias("n"))), F.when(F.col("expected_rows") != F.col("n"), F.struct(F.lit("rows other than declared").alias("warning"), (F.col("expected_rows") - F.col("n")).cast("long").alias("n")))))
    return one.select(F.explode(said).alias("w")).select("w.*")


def cascade(strategies: list[tuple[str, Callable[[], tuple[DataFrame, DataFrame]]]]) -> tuple[str, DataFrame, DataFrame]:
    """(name, records, skipped) of the first strategy that gives a record, else of the last."""
    name, records, skipped = "", None, None
    for name, run in strategies:
        records, skipped = run()
        if not records.isEmpty():
            break
    return name, records, skipped


def members(records: DataFrame, order: list[str], fill: tuple[str, ...] = ()) -> DataFrame:
    """Records as members: columns carried down, names in one form, ids, repeats flagged, the first spelling of each id.

    Rows without a name are left out.  order are the columns that give the rows' order.
    """
    given = records.withColumns({f: F.lit(None).cast("string") for f in ALIASES if f not in records.columns})
    if fill:
        spread = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)  # a list of members is small; the order is of all rows
        given = given.withColumns({c: F.last(c, ignorenulls=True).over(spread) for c in fill})
    named = given.withColumn("nom_complet", person_name(F.col(NAME))).where("nom_complet is not null")
    keyed = named.withColumn("_key", F.concat_ws("|", slug(match_key(F.col("etablissement"))), name_key(match_key(F.col("nom_complet")))))
    first = F.struct(*order)
    own = person_id(slug(match_key(F.col("etablissement"))), slug(match_key(F.col("nom_complet"))))
    ids = keyed.groupBy("_key").agg(F.min_by(own, first).alias("chercheur_id"))
    again = W.partitionBy("chercheur_id", "etablissement", "laboratoire", "equipe", "type_membre").orderBy(*order)
    return keyed.join(ids, "_key").drop("_key").withColumn("is_duplicate_row", F.row_number().over(again) > 1)


def extraction_report(records: DataFrame, skipped: DataFrame, method: str) -> DataFrame:
    """(metric, label, n): pages with rows, rows kept, and rows skipped by reason."""
    none = F.lit(None).cast("string")
    kept = records.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("p"))
    rows = kept.select(F.explode(F.array(F.struct(F.lit("rows kept").alias("metric"), F.col("n").alias("n")), F.struct(F.lit("pages with rows").alias("metric"), F.col("p").alias("n")))).alias("m")).select("m.metric", none.alias("label"), "m.n")
    why = skipped.groupBy(F.col("reason").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows skipped").alias("metric"), "label", "n")
    return rows.unionByName(why).withColumn("method", F.lit(method))
