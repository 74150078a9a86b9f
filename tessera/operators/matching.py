"""Person matching: name scores, weighted evidence, decisions, imports of identifiers and title matches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tessera.functions.text import match_key, sequence_ratio, tokens

#: Weights of evidence, limits of decisions, articles glued to names.
WEIGHTS = {"name": 0.40, "faculty": 0.25, "university": 0.15, "email": 0.10, "city": 0.05, "topic": 0.05}
NAME_LEAST, ACCEPT, MARGIN, MAYBE = 0.66, 0.70, 0.15, 0.50
ARTICLES = ("el", "al")
INITIAL, RATIO_SHARE, RATIO_LEAST = 0.75, 0.9, 0.85
CONFIRM, ENTRY_MARGIN, CERTAIN = 0.80, 0.10, 0.95
#: Names up to which a roster is broadcast.
ROSTER = 20_000


def _tail(a: str, b: str) -> float:
    """Share of the words of a, in their order, that b still has, an initial counting in part; or a high ratio of the
    sorted words, joined."""
    mine, free, score = a.split(), b.split(), 0.0
    longer = max(len(mine), len(free), 1)
    joined = ["".join(sorted(words)) for words in (mine, free)]
    for word in mine:
        worth, place = (1.0, free.index(word)) if word in free else (INITIAL, next((k for k, other in enumerate(free) if 1 in (len(word), len(other)) and word[0] == other[0]), None))
        if place is not None:
            score += worth
            del free[place]
    ratio = SequenceMatcher(None, *joined).ratio()
    return max(score / longer, RATIO_SHARE * ratio if ratio >= RATIO_LEAST else 0.0)


@pandas_udf(DoubleType())
def _tail_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_tail(x, y) for x, y in zip(a, b, strict=True)])


def _letters(tok: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.array_join(tok, ""), ""), lambda c: c != "")), "")


def name_score(a: Column, b: Column) -> Column:
    """Score of two matching keys; an empty one gives 0.  Each tier is tried in turn."""
    x, y = tokens(a), tokens(b)
    bare = lambda t: F.filter(t, lambda w: ~w.isin(*ARTICLES))
    unglued = lambda t: F.transform(t, lambda w: F.when(w.rlike("^(el|al)..."), F.substring(w, 3, 1000)).otherwise(w))
    same = lambda f: (_letters(f(x)) == _letters(f(y))) & (_letters(f(x)) != "")
    few, many = (F.array_distinct(F.when(F.size(x) <= F.size(y), p).otherwise(q)) for p, q in ((x, y), (y, x)))
    within = (F.size(F.array_except(few, many)) == 0) & (F.size(few) >= 2) & (F.size(few) < F.size(many))
    return (
        F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
        .when(F.array_sort(F.array_distinct(x)) == F.array_sort(F.array_distinct(y)), 1.0)
        .when(same(lambda t: t) | same(bare), 0.95)
        .when(same(lambda t: unglued(bare(t))), 0.93)
        .when(within, 0.85)
        .otherwise(_tail_score(a, b))
    )


def topics_meet(a: Column, b: Column, stop: list[str]) -> Column:
    """Whether two keys share a word of more than three letters that is no stop word."""
    strong = lambda t: F.filter(tokens(t), lambda w: (F.length(w) > 3) & ~w.isin(*stop))
    return F.arrays_overlap(strong(a), strong(b))


def evidence_score(name: Column, **flags: Column) -> Column:
    """Weighted sum of the name score and yes/no evidence, one at most."""
    out = name * WEIGHTS["name"]
    for kind, flag in flags.items():
        out = out + F.when(flag, WEIGHTS[kind]).otherwise(0.0)
    return F.least(F.lit(1.0), out)


def score_candidates(people: DataFrame, candidates: DataFrame, faculty: str, university: str, city: str, domain: str, stop: list[str]) -> DataFrame:
    """Candidates with name_score, evidence and score.

    people: person, name_key, context_key (their lab and team); candidates: person, candidate_id, name_key,
    affiliation_key, email_domain, interests.  faculty, university and city are patterns of affiliations, domain the end
    of the institution's mail addresses, which speaks for the university too.
    """
    both = candidates.withColumnRenamed("name_key", "_c_key").join(people.select("person", F.col("name_key").alias("_p_key"), "context_key"), "person")
    mail = F.coalesce(F.lower("email_domain").endswith(domain), F.lit(False))
    said = lambda pattern: F.coalesce(F.col("affiliation_key").rlike(pattern), F.lit(False))
    told = F.concat_ws(" ", F.coalesce("affiliation_key", F.lit("")), match_key(F.array_join(F.coalesce("interests", F.array().cast("array<string>")), " ")))
    strong = F.filter(tokens(F.coalesce("context_key", F.lit(""))), lambda w: (F.length(w) > 3) & ~w.isin(*stop))
    flags = {"faculty": said(faculty), "university": said(university) | mail, "email": mail, "city": said(city), "topic": F.arrays_overlap(strong, tokens(told))}
    scored = both.withColumns({"name_score": name_score(F.col("_p_key"), F.col("_c_key")), "evidence": F.struct(*[f.alias(k) for k, f in flags.items()])})
    return scored.withColumn("score", evidence_score(F.col("name_score"), **{k: F.col(f"evidence.{k}") for k in flags})).withColumnRenamed("_c_key", "name_key").drop("_p_key", "context_key")


def decide(candidates: DataFrame, person: str, name: str = "name_score", score: str = "score", candidate: str = "candidate_id", listed: int = 5) -> DataFrame:
    """(person, status, confidence, candidate, detail, method, listing): matched, ambiguous or not_found, by the best
    score among fitting names and its lead over the next; the five best candidates of any name, best first."""
    order = lambda *first: W.partitionBy(person).orderBy(*first, F.col(score).desc(), F.col(candidate))
    fits = F.col(name) >= NAME_LEAST
    ranked = candidates.withColumn("_fits", fits).withColumn("_r", F.row_number().over(order(F.col("_fits").desc()))).withColumn("_l", F.row_number().over(order()))
    # at most the two best that fit and the five best of all of each person go on
    few = ranked.where(f"(_fits AND _r <= 2) OR _l <= {listed}")
    nth = lambda n, c: F.max(F.when(F.col("_fits") & (F.col("_r") == n), F.col(c)))
    one = few.groupBy(person).agg(nth(1, score).alias("best"), nth(2, score).alias("next"), nth(1, candidate).alias("_id"), F.array_sort(F.collect_list(F.when(F.col("_l") <= listed, F.struct(F.col("_l").alias("rank"), F.col(candidate), F.round(score, 3).alias("score"), F.round(name, 3).alias("name_score"))))).alias("listing"))
    clear = F.col("next").isNull() | (F.col("best") - F.col("next") >= MARGIN)
    status = F.when((F.col("best") >= ACCEPT) & clear, "matched").when(F.col("best") >= MAYBE, "ambiguous").otherwise("not_found")
    detail = F.when(F.col("best").isNull(), "no fitting name").when(status == "matched", "clear").when(status == "not_found", "too low").when(~clear, "several candidates").otherwise("too low to accept")
    return one.select(person, status.alias("status"), F.round("best", 3).alias("confidence"), F.when(status == "matched", F.col("_id")).alias(candidate), detail.alias("detail"), F.lit("auto_scoring").alias("method"), "listing")


def coauthor_bonus(coauthors: DataFrame, roster: DataFrame, person: str = "person") -> DataFrame:
    """(person, bonus, hits): 0.05 for each co-author on the roster, 0.10 at most, the person's own name aside.

    coauthors: person, name_key (the person's), coauthor_key; roster: name_key.  A roster of more than ROSTER names is
    not broadcast.
    """
    names = roster.select(F.col("name_key").alias("_r")).distinct()
    names = F.broadcast(names) if names.count() <= ROSTER else names
    others = coauthors.select(person, "name_key").distinct().join(names).where(name_score(F.col("_r"), F.col("name_key")) < 0.9).select(person, "_r")
    met = coauthors.select(person, "coauthor_key").join(others, person).where(name_score(F.col("coauthor_key"), F.col("_r")) >= CERTAIN).select(person, F.col("coauthor_key").alias("hit")).distinct()
    counted = coauthors.select(person, F.col("coauthor_key").alias("hit")).join(met, [person, "hit"], "left_semi").groupBy(person).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("hit")).alias("hits"))
    return coauthors.select(person).distinct().join(counted, person, "left").select(person, F.least(F.lit(0.10), 0.05 * F.coalesce("n", F.lit(0))).alias("bonus"), F.coalesce("hits", F.array().cast("array<string>")).alias("hits"))


def blended_confidence(name: Column) -> Column:
    """Confidence of a person found in the fallback source, by name at the institution."""
    return F.round(0.6 * name + 0.4, 3)


def raised_confidence(confidence: Column, bonus: Column) -> Column:
    return F.round(F.least(F.lit(1.0), confidence + bonus), 3)


def first_sighting(candidates: DataFrame, person: str, candidate: str, template_rank: str) -> DataFrame:
    """Pool of several queries: each candidate once, as first seen."""
    return candidates.withColumn("_r", F.row_number().over(W.partitionBy(person, candidate).orderBy(template_rank))).where("_r = 1").drop("_r")


def decide_by_templates(candidates: DataFrame, person: str, templates: int, rank: str = "template_rank", candidate: str = "candidate_id") -> DataFrame:
    """decide() over the pools of several queries, asked in order (rank from 1): a person's pool grows query by query, and
    the first that gives a match or several candidates decides; else the last one does."""
    pool = first_sighting(candidates, person, candidate, rank)
    out = None
    for n in range(1, templates + 1):
        told = decide(pool.where(F.col(rank) <= n), person, candidate=candidate).withColumn("asked", F.lit(n))
        out = told if out is None else out.unionByName(told)
    settled = F.col("status").isin("matched", "ambiguous")
    order = W.partitionBy(person).orderBy((~settled).cast("int"), F.when(settled, F.col("asked")).otherwise(-F.col("asked")))
    return out.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def with_override(decisions: DataFrame, overrides: DataFrame, person: str, candidate: str = "candidate_id") -> DataFrame:
    forced = overrides.select(person, F.col(candidate).alias("_forced"))
    joined = decisions.join(forced, person, "left")
    has = F.col("_forced").isNotNull()
    return joined.withColumn("status", F.when(has, "matched").otherwise(F.col("status"))).withColumn("confidence", F.when(has, 1.0).otherwise(F.col("confidence"))).withColumn(candidate, F.coalesce("_forced", candidate)).drop("_forced")


def match_entries(entries: DataFrame, roster: DataFrame, home: str) -> DataFrame:
    """Import of (pos, name_key, external_id) against (person_id, name_key, institution_key).

    Every entry meets the whole roster, which is broadcast up to ROSTER people.  Status in this order: not_in_roster,
    ambiguous, other_institution, invalid_id, conflict, accepted.
    """
    people = roster.select("person_id", F.col("name_key").alias("r_key"), "institution_key")
    people = F.broadcast(people) if people.count() <= ROSTER else people
    scored = entries.join(people).withColumn("score", name_score(F.col("name_key"), F.col("r_key")))
    w = W.partitionBy("pos").orderBy(F.col("score").desc(), F.col("person_id"))
    best = scored.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("_r = 1")
    status = (
        F.when(F.col("score") < CONFIRM, "not_in_roster")
        .when(F.col("score") - F.col("_next") < ENTRY_MARGIN, "ambiguous")
        .when(F.col("institution_key") != home, "other_institution")
        .when(~F.coalesce(F.col("external_id").rlike("^[A-Za-z0-9_-]{12}$"), F.lit(False)), "invalid_id")
    )
    judged = best.withColumn("status", status)
    first = F.first(F.when(F.col("status").isNull(), F.col("external_id")), ignorenulls=True).over(W.partitionBy("person_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    final = F.coalesce("status", F.when(first != F.col("external_id"), "conflict").otherwise("accepted"))
    return judged.withColumn("status", final).select("pos", "person_id", "external_id", "score", "status", ((F.col("status") == "accepted") & (F.col("score") < CERTAIN)).alias("to_verify"))


def choose_author(candidates: DataFrame, person: str) -> DataFrame:
    """From (person, author_id, score, at_home, works): the author of most works, unless another one is large too.

    Smaller ones whose score is at least 0.93 are fragments of the same author and are merged.
    """
    fit = candidates.where((F.col("score") >= 0.90) & F.col("at_home"))
    w = W.partitionBy(person).orderBy(F.col("works").desc(), F.col("author_id"))
    first = fit.withColumn("_r", F.row_number().over(w)).withColumn("_top", F.max("works").over(W.partitionBy(person)))
    rival = (F.col("_r") > 1) & (F.col("works") >= F.greatest(F.lit(20.0), 0.5 * F.col("_top")))
    return first.groupBy(person).agg(F.when(F.bool_or(rival), "ambiguous").otherwise("matched").alias("status"), F.min_by("author_id", "_r").alias("author_id"), F.array_sort(F.collect_set(F.when((F.col("_r") == 1) | (F.col("score") >= 0.93), F.col("author_id")))).alias("merged_ids"))


def best_title(items: DataFrame, candidates: DataFrame, item: str, least: float = 0.90, within: int = 1) -> DataFrame:
    """For each (item, title_key, year) its best of (item, pos, title_key, year): highest ratio, first of equals."""
    c = candidates.select(item, "pos", F.col("title_key").alias("c_key"), F.col("year").alias("c_year"))
    near = items.join(c, item).where(F.col("year").isNull() | F.col("c_year").isNull() | (F.abs(F.col("year") - F.col("c_year")) <= within))
    scored = near.withColumn("ratio", sequence_ratio(F.col("title_key"), F.col("c_key"))).where(F.col("ratio") >= least)
    return scored.groupBy(item).agg(F.max_by(F.struct("pos", "ratio"), F.struct("ratio", -F.col("pos"))).alias("m")).select(item, "m.pos", "m.ratio")


def recall(primary: DataFrame, fallback: DataFrame, owner: str) -> DataFrame:
    """Share of each owner's primary works that the fallback has, by DOI or title ratio of 0.9; the row without an owner
    is the mean of the owners."""
    p = primary.select(owner, F.col("doi").alias("p_doi"), F.col("title_key").alias("p_key"), F.monotonically_increasing_id().alias("_p"))
    f = fallback.select(owner, F.col("doi").alias("f_doi"), F.col("title_key").alias("f_key"))
    joined = p.join(f, owner, "left").withColumn("_ratio", F.when(F.col("p_doi") == F.col("f_doi"), 1.0).when(F.col("f_key").isNull(), 0.0).otherwise(sequence_ratio(F.coalesce("p_key", F.lit("")), F.coalesce("f_key", F.lit("")))))
    each = joined.groupBy(owner, "_p").agg(F.max((F.col("_ratio") >= 0.9).cast("int")).alias("hit")).groupBy(owner).agg(F.avg("hit").alias("recall"))
    return each.unionByName(each.agg(F.lit(None).cast(each.schema[owner].dataType).alias(owner), F.avg("recall").alias("recall")))
