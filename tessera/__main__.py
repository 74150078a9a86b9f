"""python -m tessera COMMAND: the steps of the work on tables in folders.

Every table is a Parquet folder, or a CSV file with a header where its name ends in .csv; results are Parquet.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def members(spark: SparkSession, a: argparse.Namespace) -> None:
    """Word boxes of pages to members and what was skipped."""
    from tessera.operators import layout

    kept, skipped = layout.words_to_records(_read(spark, a.words))
    layout.members(kept, ["page", "row_number"], tuple(a.forward_fill)).write.mode("overwrite").parquet(f"{a.output}/members")
    skipped.write.mode("overwrite").parquet(f"{a.output}/skipped")


def clean(spark: SparkSession, a: argparse.Namespace) -> None:
    """Raw records to articles, links, counts and broken rules."""
    from tessera.operators import quality, records

    found = records.resolve(_read(spark, a.records), _read(spark, a.people) if a.people else None)
    for name, table in found.items():
        table.write.mode("overwrite").parquet(f"{a.output}/{name}")
    quality.article_errors(spark.read.parquet(f"{a.output}/articles")).write.mode("overwrite").parquet(f"{a.output}/errors")


def embed(spark: SparkSession, a: argparse.Namespace) -> None:
    """Texts of articles to vectors, by the stand-in for a model."""
    from tessera.operators import embed as em

    out, _ = em.embed(em.embeddable(_read(spark, a.articles), a.limit), "embedding_text", "hashed-words", size=a.batch_size)
    out.select("article_id", "key", "embedding").write.mode("overwrite").parquet(a.output)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Vectors to a searchable index."""
    from tessera.operators.engine import save_index

    save_index(_read(spark, a.vectors), a.output, "article_id")


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    """Records, or people, nearest to texts."""
    from tessera.operators.engine import Engine

    engine = Engine.load(spark, a.index, _read(spark, a.articles), _read(spark, a.people), _read(spark, a.links))
    found = engine.search_people(a.query, a.top_k) if a.people_first else engine.search(a.query, a.top_k)
    found.show(a.top_k * len(a.query), 80)


def semantic_map(spark: SparkSession, a: argparse.Namespace) -> None:
    """Points and clusters of a map."""
    from tessera.catalog import STOP
    from tessera.operators import topics

    points, told = topics.semantic_map(_read(spark, a.articles), _read(spark, a.links), _read(spark, a.people), STOP, a.clusters)
    points.write.mode("overwrite").parquet(f"{a.output}/points")
    told.write.mode("overwrite").parquet(f"{a.output}/clusters")


def describe(spark: SparkSession, a: argparse.Namespace) -> None:
    """The tables behind the charts."""
    from tessera.operators.charts import chart_tables

    for name, table in chart_tables(_read(spark, a.people), _read(spark, a.articles), _read(spark, a.links)).items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{a.output}/{name}")


def ids(spark: SparkSession, a: argparse.Namespace) -> None:
    """Identifiers entered for people, each with what became of it."""
    from tessera.functions.text import match_key
    from tessera.operators.matching import match_entries

    entries = _read(spark, a.entries).select(F.col("pos").cast("long").alias("pos"), match_key(F.col("nom_complet")).alias("name_key"), "external_id")
    roster = _read(spark, a.people).select(F.col("chercheur_id").alias("person_id"), match_key(F.col("nom_complet")).alias("name_key"), match_key(F.col("etablissement")).alias("institution_key"))
    found = match_entries(entries, roster, a.home)
    found.show(1000, False) if a.dry_run else found.write.mode("overwrite").parquet(a.output)


#: Command: function, tables that must be given, other options.
COMMANDS = {
    "members": (members, ["words", "output"], {"--forward-fill": {"nargs": "*", "default": []}}),
    "clean": (clean, ["records", "output"], {"--people": {}}),
    "embed": (embed, ["articles", "output"], {"--limit": {"type": int}, "--batch-size": {"type": int, "default": 16}}),
    "index": (index, ["vectors", "output"], {}),
    "search": (search, ["index", "articles", "people", "links"], {"--query": {"nargs": "+", "required": True}, "--top-k": {"type": int, "default": 5}, "--people-first": {"action": "store_true"}}),
    "map": (semantic_map, ["articles", "links", "people", "output"], {"--clusters": {"type": int}}),
    "describe": (describe, ["people", "articles", "links", "output"], {}),
    "ids": (ids, ["entries", "people", "output"], {"--home": {"required": True}, "--dry-run": {"action": "store_true"}}),
}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (run, tables, options) in COMMANDS.items():
        one = commands.add_parser(name, help=(run.__doc__ or "").splitlines()[0])
        for table in tables:
            one.add_argument(f"--{table}", required=True)
        for option, how in options.items():
            one.add_argument(option, **how)
    a = parser.parse_args(arguments)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("tessera").getOrCreate(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
