"""Embedding with a cache table: distinct texts, misses in batches by count and bytes, results in input order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES, OVERHEAD = 4_000_000, 150


def cache_key(text: Column, model: str, dims: int | None = None, kind: str = "document") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(dims) if dims else "default"), F.lit(kind), text), 256)


def make_batches(texts: list[str], size: int, most: int = MOST_BYTES) -> Iterator[list[str]]:
    """Runs of at most `size` texts whose bytes, with an overhead each, stay within `most`."""
    batch, total = [], 0
    for t in texts:
        cost = OVERHEAD + len(t.encode())
        if batch and (len(batch) >= size or total + cost > most):
            yield batch
            batch, total = [], 0
        batch.append(t)
        total += cost
    if batch:
        yield batch


def hashed_words(texts: list[str], dim: int = 128) -> np.ndarray:
    """Stand-in for a model: counts of words by md5 modulo dim, on unit length."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            out[i, int(hashlib.md5(w.encode()).hexdigest(), 16) % dim] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, text: str, model: str, encode: Callable[[list[str]], np.ndarray] = hashed_words, cache: DataFrame | None = None, size: int = 16) -> tuple[DataFrame, DataFrame]:
    """(df with key and embedding, rows new to the cache).  Blank texts get no embedding."""
    keyed = df.withColumn("key", F.when(F.length(F.trim(text)) > 0, cache_key(F.col(text), model)))
    wanted = keyed.where("key is not null").select("key", F.col(text).alias("text")).dropDuplicates(["key"])
    misses = wanted.join(cache.select("key"), "key", "left_anti") if cache is not None else wanted

    def run(frames):
        for frame in frames:
            done = 0
            for batch in make_batches(frame["text"].tolist(), size):
                vectors = np.asarray(encode(batch), np.float32)
                if len(vectors) != len(batch) or not np.isfinite(vectors).all():
                    raise ValueError("the embedder returned a wrong number of vectors, or components that are not finite")
                yield pd.DataFrame({"key": frame["key"].iloc[done : done + len(batch)].to_numpy(), "embedding": list(vectors)})
                done += len(batch)

    fresh = misses.mapInPandas(run, "key string, embedding array<float>")
    known = fresh if cache is None else fresh.unionByName(cache.select("key", "embedding"))
    return keyed.join(known, "key", "left"), fresh


def embeddable(articles: DataFrame, limit: int | None = None, key: str = "article_id") -> DataFrame:
    """Articles that have a text to embed; the first by key where a limit is set."""
    found = articles.where(F.col("embedding_text").isNotNull() & (F.col("embedding_source") != "none"))
    return found if limit is None else found.orderBy(key).limit(limit)


def checked(encode: Callable[[list[str]], object], dim: int | None = None, model: str | None = None, expected: str | None = None, retries: int = 3, sleep: Callable[[float], None] | None = None) -> Callable[[list[str]], np.ndarray]:
    """An encoder whose answers are a finite matrix, one row for each text, `dim` wide; transient faults are replayed.

    model, the transport's, has to be the one expected: vectors of two models are not to be compared.
    """
    import time

    from tessera.sources.calls import Unreadable, replayed

    if expected is not None and model != expected:
        raise ValueError(f"model {model}, not {expected}")

    def once(texts: list[str]) -> np.ndarray:
        out = np.asarray(encode(texts), np.float32)
        if out.ndim != 2 or len(out) != len(texts) or (dim is not None and out.shape[1] != dim) or not np.isfinite(out).all():
            raise Unreadable(f"{len(texts)} texts gave an array of {out.shape}, or components that are not finite")
        return out

    return replayed(once, retries, sleep=sleep or time.sleep)


MOST_ATTACHED = 3_000_000


def attach(nested: DataFrame, vectors: DataFrame, policy: str = "auto", items: str = "articles", item: str = "article_id", vector: str = "embedding") -> DataFrame:
    """Nested rows whose items get their vector, rounded to 5 places, or null.

    policy: true, false, or auto, which attaches as long as items times dimensions are at most MOST_ATTACHED.
    """
    key = nested.columns[0]
    if policy == "auto":
        entries = nested.agg(F.coalesce(F.sum(F.size(items)), F.lit(0))).first()[0]
        width = vectors.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]
        policy = "true" if entries * width <= MOST_ATTACHED else "false"
    each = nested.select(F.col(key).alias("_k"), F.posexplode_outer(items).alias("_p", "_i"))
    rounded = vectors.select(F.col(item).alias("_v"), F.transform(vector, lambda x: F.round(x.cast("double"), 5)).alias("_e"))
    told = each.join(rounded, F.col(f"_i.{item}") == F.col("_v"), "left") if policy == "true" else each.withColumn("_e", F.lit(None).cast("array<double>"))
    again = told.where("_p IS NOT NULL").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_p", F.struct("_i.*", F.col("_e").alias(vector)).alias("x")))).alias("_x"))
    empty = F.array().cast(again.select(F.transform("_x", lambda s: s["x"]).alias("y")).schema["y"].dataType)
    return nested.join(again, F.col(key) == F.col("_k"), "left").withColumn(items, F.coalesce(F.transform("_x", lambda s: s["x"]), empty)).drop("_k", "_x")
