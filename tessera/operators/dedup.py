"""Duplicate records of one work: edges by identifier and title, components, survivorship and links.

The fuzzy edges compare only records that share a rare word: for a token Jaccard of t two token sets of n words
must meet among their n - ceil(t n) + 1 rarest (prefix filter, Bayardo, Ma and Srikant, WWW 2007), so no year is
compared with itself in full.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.text import tokens
from tessera.functions.values import years_agree
from tessera.plans.shared import discard, materialise, scratch, tidy

from .components import connected_components

#: Words that tell parts of a series apart.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
THRESHOLD, JACCARD_NUM, JACCARD_DEN = 0.93, 3, 5


def markers(tok: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tok, lambda t: t.rlike(r"^\d+$") | t.isin(*ROMAN))))


def doi_conflict(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def doi_edges(records: DataFrame) -> DataFrame:
    """A star from the first record of each DOI."""
    named = records.where("doi is not null").select("rid", "doi")
    first = named.groupBy("doi").agg(F.min("rid").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(first, "doi").where("rid <> src").select("src", F.col("rid").alias("dst"))


def _points(records: DataFrame) -> DataFrame:
    """(rid, name, year, doi, words, kinds, point, last) of the records: a digest of the title, how many words and different
    words it has, and the least and the greatest of those alike in title, year and DOI.  What follows compares and moves
    digests, not titles."""
    tok = tokens(F.col("title_key"))
    named = records.select("rid", F.unhex(F.sha2("title_key", 256)).alias("name"), "year", "doi", F.size(tok).alias("words"), F.size(F.array_distinct(tok)).alias("kinds"))
    ends = named.groupBy(F.col("name").alias("_t"), F.col("year").alias("_y"), F.col("doi").alias("_d")).agg(F.min("rid").alias("point"), F.max("rid").alias("last"))
    alike = F.col("name").eqNullSafe(F.col("_t")) & F.col("year").eqNullSafe(F.col("_y")) & F.col("doi").eqNullSafe(F.col("_d"))
    return named.join(ends, alike).drop("_t", "_y", "_d")


def title_edges(records: DataFrame) -> DataFrame:
    """Same title of at least three words, years equal or unknown, no two DOIs.

    Records alike in title, year and DOI are one point, so copies add a star and not all pairs.
    """
    return _title_edges(_points(records))


def _title_edges(points: DataFrame) -> DataFrame:
    points = points.where("words >= 3")
    star = points.where("rid <> point").select(F.col("point").alias("src"), F.col("rid").alias("dst"))
    distinct = points.where("rid = point").select("rid", "name", "year", "doi")
    # without a DOI a title has one point a year, so few meet all; two with DOIs meet only over one DOI
    bare, named = distinct.where("doi IS NULL"), distinct.where("doi IS NOT NULL")

    def pairs(left: DataFrame, right: DataFrame, same: list[str], once: bool) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        fit = years_agree(F.col("a.year"), F.col("b.year"))
        for column in same:
            fit = fit & (F.col(f"a.{column}") == F.col(f"b.{column}"))
        met = a.join(b, fit & (F.col("a.rid") < F.col("b.rid")) if once else fit)
        return met.select(F.least("a.rid", "b.rid").alias("src"), F.greatest("a.rid", "b.rid").alias("dst"))

    return star.unionByName(pairs(bare, bare, ["name"], True)).unionByName(pairs(bare, named, ["name"], False)).unionByName(pairs(named, named, ["name", "doi"], True))


#: Words that are told apart by frequency; the rest, all rarer, come first by their hashes.  Any one order of words is exact.
FREQUENT = 1 << 16


def _prefixes(titles: DataFrame) -> DataFrame:
    """(t, years, l, n, p, h): the rarest words of each title of n different words, at place p in the order of all words.

    h mixes the hashes of a word and of the title's markers, as titles with other markers do not meet.
    """
    tok = F.array_distinct(tokens(F.col("title_key")))
    hashed = titles.select("t", "years", F.length("title_key").alias("l"), F.xxhash64(markers(tok)).alias("m"), F.transform(tok, lambda t: F.xxhash64(t)).alias("h"))
    often = hashed.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "h").limit(FREQUENT).toArrow()
    by_hash = np.argsort(often.column("h").to_numpy())
    known, counts = often.column("h").to_numpy()[by_hash], often.column("df").to_numpy()[by_hash]

    def rarest(batches):
        for batch in batches:
            words = batch.column("h")
            n = words.value_lengths().to_numpy(zero_copy_only=False)
            h, row = words.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
            near = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            df = np.where(known[near] == h, counts[near], 0) if len(known) else np.zeros(len(h), np.int64)
            order = np.lexsort((h, df, row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + 1
            kept = place <= (n - (JACCARD_NUM * n + JACCARD_DEN - 1) // JACCARD_DEN + 1)[row]
            of = pa.array(row[kept])
            mixed = h[order][kept] ^ batch.column("m").to_numpy(zero_copy_only=False)[row[kept]]
            yield pa.record_batch([batch.column("t").take(of), batch.column("years").take(of), batch.column("l").take(of), pa.array(n[row[kept]].astype(np.int32)), pa.array(place[kept].astype(np.int32)), pa.array(mixed)], ["t", "years", "l", "n", "p", "h"])

    return hashed.mapInArrow(rarest, "t long, years long, l int, n int, p int, h long")


def _alike(threshold: float):
    """Whether two titles have the Jaccard coefficient, the same markers and the ratio, which depends on their order: 1 if
    they have it with a first, 2 if with b first, 3 if both ways, else 0; cheap conditions first.  Only the ways in tried
    are looked at."""

    @pandas_udf("int")
    def alike(a: pd.Series, b: pd.Series, tried: pd.Series) -> pd.Series:
        def one(x: str, y: str, ways: int) -> int:
            left, right = ({t for t in title.split(" ") if t} for title in (x, y))
            common = len(left & right)
            if common * JACCARD_DEN < (len(left) + len(right) - common) * JACCARD_NUM:
                return 0
            if any(t in ROMAN or (t.isascii() and t.isdigit()) for t in left ^ right):
                return 0
            if SequenceMatcher(None, x, y).quick_ratio() < threshold:
                return 0
            return sum(way for way, pair in ((1, (x, y)), (2, (y, x))) if ways & way and SequenceMatcher(None, *pair).ratio() >= threshold)

        return pd.Series([one(*each) for each in zip(a, b, tried, strict=True)], dtype="int32")

    return alike


def fuzzy_edges(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Years at most one apart, four words or more, token Jaccard of 0.6, the same markers, ratio above the threshold.

    The edges have the components of all such pairs without two DOIs, see _fuzzy_edges().
    """
    return _fuzzy_edges(records, _points(records), threshold)


def _near_titles(titles: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, ways) of titles (t, title_key, years, hi, y0, y1), each title once, src < dst, ways as of _alike(), as far as
    the first and last records t and hi and the first and last years y0 and y1 leave them open.

    Two titles meet at a word of their prefixes if they can reach the Jaccard coefficient by its places (Xiao et al.,
    "Efficient Similarity Joins for Near Duplicate Detection", 2008).  All words they share up to the end of that prefix
    which ends first are counted, so they are read only if these and what is left after a prefix can reach it: titles of
    as many words must share some 15 % of them in their prefixes.  Both sides of the join are one exchange.  A bit of
    years is a year modulo 64, so some titles too many may meet here.
    """
    prefix = materialise(_prefixes(titles), "prefixes")
    around = lambda x: x.bitwiseOR(F.shiftleft(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 63)).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftleft(x, 63))
    x, y = (lambda name: F.col(f"a.{name}")), (lambda name: F.col(f"b.{name}"))
    both = x("n") + y("n")
    length = (x("n") * JACCARD_NUM <= y("n") * JACCARD_DEN) & (y("n") * JACCARD_NUM <= x("n") * JACCARD_DEN) & (2 * F.least(x("l"), y("l")) >= threshold * (x("l") + y("l")))
    rest = F.least(x("n") - x("p"), y("n") - y("p"))
    reach = (JACCARD_NUM + JACCARD_DEN) * (F.least(x("p"), y("p")) + rest) >= JACCARD_NUM * both
    met = prefix.alias("a").join(prefix.alias("b"), (x("h") == y("h")) & (x("t") < y("t")) & length & reach & (x("years").bitwiseAND(around(y("years"))) != 0))
    left = F.greatest(*[F.floor((n * JACCARD_NUM + JACCARD_DEN - 1) / JACCARD_DEN) - 1 for n in (x("n"), y("n"))])
    need = JACCARD_NUM * both - (JACCARD_NUM + JACCARD_DEN) * left
    met = met.select(x("t").alias("src"), y("t").alias("dst"), need.alias("need")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need"))
    pairs = materialise(met.where((JACCARD_NUM + JACCARD_DEN) * F.col("c") >= F.col("need")).select("src", "dst"), "pairs")
    discard(prefix)
    full = pairs.join(titles.select(F.col("t").alias("src"), "title_key", "hi", "y0", "y1").alias("a"), "src").join(titles.select(F.col("t").alias("dst"), "title_key", "y0", "y1").alias("b"), "dst")
    tried = (x("y0") <= y("y1")).cast("int") + 2 * ((y("y0") < x("y1")) | ((y("y0") == x("y1")) & (F.col("dst") < x("hi")))).cast("int")
    found = materialise(full.select("src", "dst", _alike(threshold)(x("title_key"), y("title_key"), tried).alias("ways")).where("ways > 0"), "near")
    discard(pairs)
    return found


def _fuzzy_edges(records: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """Titles meet once, however many years and DOIs they have; their points are linked by stars.

    Two points with DOIs have a conflict or are linked by their DOI, so of each pair one has no DOI (a bare point; a title
    has one a year).  In one year the earlier record comes first, so by the order of titles that has the ratio, a bare
    point meets of the points of another title and year all, those with a record after its first (they go on from the
    point that reaches last), or those with a record before its last (they go on from the first point).
    """
    points = points.where("year IS NOT NULL AND kinds >= 4")
    distinct = points.where("rid = point").select("name", F.col("year").cast("int").alias("year"), F.col("doi").isNull().alias("bare"), F.col("rid").alias("lo"), F.col("last").alias("hi"))
    named = distinct.groupBy("name").agg(F.min("lo").alias("t"), F.max("hi").alias("hi"), F.min("year").alias("y0"), F.max("year").alias("y1"), F.expr("bit_or(shiftleft(1L, int(pmod(year, 64))))").alias("years"))
    titles = materialise(records.select(F.col("rid").alias("t"), "title_key").join(named, "t"), "titles")
    points_of = materialise(distinct.join(titles.select("name", "t"), "name").drop("name"), "points")
    near = _near_titles(titles, threshold)

    bit = lambda k: F.col("ways").bitwiseAND(k) != 0
    each = near.select(F.col("src").alias("p"), F.col("dst").alias("q"), bit(1).alias("before"), bit(2).alias("after"))
    each = each.unionByName(near.select(F.col("dst").alias("p"), F.col("src").alias("q"), bit(2).alias("before"), bit(1).alias("after")))
    each = each.unionByName(titles.select(F.col("t").alias("p"), F.col("t").alias("q"), F.lit(threshold <= 1).alias("before"), F.lit(threshold <= 1).alias("after")))
    bare = points_of.where("bare").select(F.col("t").alias("p"), F.col("year").alias("yp"), F.col("lo").alias("src"), F.col("hi").alias("hi_p"))
    shelf = points_of.groupBy(F.col("t").alias("q"), F.col("year").alias("yq")).agg(F.min("lo").alias("first"), F.max("hi").alias("hi_q"), F.max_by("lo", "hi").alias("last"))
    met = each.join(bare, "p").join(shelf, "q").where(F.abs(F.col("yp") - F.col("yq")) <= 1)
    same = F.col("yp") == F.col("yq")
    whole = (F.col("before") & (F.col("yp") < F.col("yq"))) | (F.col("after") & (F.col("yp") > F.col("yq")))
    # points of q with lo < upto meet from the first, those with hi > since from the last
    upto = F.when(whole, F.lit((1 << 63) - 1)).when(F.col("after") & same & (F.col("first") < F.col("hi_p")), F.col("hi_p"))
    since = F.when(F.col("before") & same & (F.col("hi_q") > F.col("src")), F.col("src"))
    met = materialise(met.select("src", "q", "yq", "first", "last", upto.alias("upto"), since.alias("since")).where("upto IS NOT NULL OR since IS NOT NULL"), "met")
    reach = met.groupBy("q", "yq").agg(F.min("first").alias("first"), F.min("last").alias("last"), F.max("upto").alias("upto"), F.min("since").alias("since"))
    star = points_of.join(reach, (F.col("t") == F.col("q")) & (F.col("year") == F.col("yq")))
    pairs = [
        met.where("upto IS NOT NULL").select("src", F.col("first").alias("dst")), met.where("since IS NOT NULL").select("src", F.col("last").alias("dst")),
        star.where("lo < upto").select(F.col("first").alias("src"), F.col("lo").alias("dst")), star.where("hi > since").select(F.col("last").alias("src"), F.col("lo").alias("dst")),
        points.where("rid <> point").select(F.col("point").alias("src"), F.col("rid").alias("dst")),
    ]
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    return found.where("src <> dst")


def group_records(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """records (rid, title_key, year, doi, ...) with root, the least rid of its group.

    The relation is closed transitively: two DOIs may meet through a record without one.
    """
    with scratch() as steps, tidy(records.sparkSession):
        thin = materialise(records.select("rid", "title_key", "year", "doi"), "records")
        points = materialise(_points(thin), "points")
        edges = doi_edges(points).unionByName(_title_edges(points)).unionByName(_fuzzy_edges(thin, points, threshold))
        labels = steps.keep(materialise(connected_components(edges).select(F.col("node").alias("rid"), F.col("component").alias("root")), "labels"))
    return records.join(labels, "rid", "left").withColumn("root", F.coalesce("root", "rid"))


def survivors(grouped: DataFrame, fields: list[str], rank: list[Column]) -> DataFrame:
    """One row for each group: each field from the record of least rank that has it, by partial aggregates."""
    order = F.struct(*[r.alias(f"r{k}") for k, r in enumerate(rank)], F.col("rid"))
    return grouped.groupBy("root").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields], F.count(F.lit(1)).alias("n_source_records"), F.array_sort(F.collect_list("rid")).alias("rids"))


def number_articles(merged: DataFrame) -> DataFrame:
    """article_id by rank of (title, year or 0), ties by least record.

    The articles are written once, dealt by ranges of that order; a rank is a place in a range and the sizes of those before.
    """
    order = ["title_key", F.coalesce("year", F.lit(0)), "root"]
    dealt = merged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    with tidy(merged.sparkSession):
        placed = materialise(dealt, "articles").withColumn("_range", F.shiftright("_id", 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    place = F.col("_id").bitwiseAND((1 << 33) - 1) + 1 + F.coalesce("_before", F.lit(0))
    return placed.join(F.broadcast(sizes.select("_range", ahead.alias("_before"))), "_range").withColumn("article_id", F.format_string("art_%05d", place)).drop("_id", "_range", "_before")


def owner_links(merged: DataFrame, raw_ids: str = "raw_ids") -> DataFrame:
    """(owner, article_id, raw_id): owner is what stands before '::'; the first raw id of each pair is kept."""
    each = merged.select("article_id", F.posexplode(raw_ids).alias("pos", "raw_id")).withColumn("owner", F.split_part("raw_id", F.lit("::"), F.lit(1)))
    return each.groupBy("owner", "article_id").agg(F.min_by("raw_id", "pos").alias("raw_id"))
