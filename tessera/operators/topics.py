"""Semantic map: two dimensions, clusters with a chosen k, terms and central titles of each cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tessera.plans.shared import materialise, scratch

from .relational import top_per_group
from .vectors import dot, unit

SEED = 42


def two_dimensions(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Columns x and y by principal components of the unit vectors; three rows at least."""
    if df.where(F.col(vector).isNotNull()).limit(3).count() < 3:
        raise ValueError("a map needs three rows at least")
    v = df.withColumn("_f", array_to_vector(unit(F.col(vector))))
    out = PCA(k=2, inputCol="_f", outputCol="_xy").fit(v).transform(v).withColumn("_xy", vector_to_array("_xy"))
    return out.withColumn("x", F.col("_xy")[0]).withColumn("y", F.col("_xy")[1]).drop("_f", "_xy")


def clusters(df: DataFrame, k: int | None = None, k_range: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8), vector: str = "embedding", restarts: int = 10, sample: int = 4000) -> DataFrame:
    """Column cluster: Euclidean k-means on unit vectors, the best of several seeds.

    Without k, the k of greatest cosine silhouette on a sample of at most `sample` rows.
    """
    v = df.withColumn("_f", array_to_vector(unit(F.col(vector)))).cache()
    fit = lambda data, n, seed: KMeans(k=n, seed=seed, featuresCol="_f", predictionCol="cluster").fit(data)
    if k is None:
        rows = v.count()
        part = v.where(F.shiftrightunsigned(F.xxhash64(*[c for c in df.columns if c != vector]), 1) <= int(2**63 * min(1.0, sample / max(rows, 1)) - 1))
        judge = ClusteringEvaluator(featuresCol="_f", predictionCol="cluster", distanceMeasure="cosine")
        k = max(k_range, key=lambda n: judge.evaluate(fit(part, n, SEED).transform(part)))
    best = min((fit(v, k, SEED + i) for i in range(restarts)), key=lambda m: m.summary.trainingCost)
    return best.transform(v).drop("_f")


#: Terms that a task holds at once, characters of text for each range of hashes, terms listed for a cluster at first.
BLOCK_TERMS, RANGE_CHARS, LISTED = 1 << 20, 12 << 20, 512


def _terms(words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, place of the first word, words) of the words and pairs of a column of lists of hashes; 0 ends a text."""
    n = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    h, row = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(n)), n)
    one, two = np.flatnonzero(h), np.flatnonzero((row[:-1] == row[1:]) & (h[:-1] != 0) & (h[1:] != 0))
    mixed = (h[two] ^ ((h[two + 1] << np.uint64(31)) | (h[two + 1] >> np.uint64(33)))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sizes = np.repeat([1, 2], [len(one), len(two)])
    return np.concatenate([row[one], row[two]]), np.concatenate([h[one], mixed ^ (mixed >> np.uint64(32))]), np.concatenate([one, two]), sizes


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield batch.slice(at, 500)


def _pack(x: np.ndarray) -> bytes:
    """Byte by byte of all numbers, so that high bytes compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpack(b: pa.BinaryScalar, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b.as_buffer(), np.uint8).reshape(width, -1).T).view(kind).ravel()


def cluster_terms(docs: DataFrame, key: str, text: str, cluster: str, stop: list[str], top: int = 6, least_docs: int = 2) -> DataFrame:
    """(cluster, rank, term, weight): greatest mean of smoothed, length-normalised TF-IDF over words and pairs.

    Blocks of texts send the 64-bit hashes of their terms, with the texts that have them, to ranges of the hashes, which know
    how many texts have a term and return each text's share of its length.  A weight is at most what it would be by that share
    alone, so only terms of the greatest such sums are weighed, and more of them until no other can be among the top; only
    these become words again.
    """
    spark = docs.sparkSession
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(*stop))
    said = docs.select(F.col(key).alias("key"), F.col(cluster).alias("cluster"), F.coalesce(words, F.array().cast("array<string>")).alias("w"))
    hashes = F.transform("w", lambda w: F.xxhash64(w)).alias("h")
    hashed = said.select("key", "cluster", hashes)
    if not docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        ended = hashed.select("key", "cluster", F.concat("h", F.array(F.lit(0).cast("long"))).alias("h"))
        hashed = ended.groupBy("key", "cluster").agg(F.flatten(F.collect_list("h")).alias("h"))
    counted = docs.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).collect()
    n, kind = sum(r["size"] for r in counted), docs.schema[cluster].dataType
    named = [r for r in counted if r[cluster] is not None]
    names = pa.array([r[cluster] for r in named], to_arrow_type(kind))
    ranges = max(1, -(-sum(r["chars"] for r in counted) // RANGE_CHARS))
    bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    listed = LISTED
    while True:
        per_range = max(64, 8 * listed // ranges)
        with scratch():
            told = materialise(_told(hashed, names, bounds, n, least_docs, per_range), "terms")
            norms = materialise(_norms(told, docs.schema[key].dataType), "norms")
            lists = told.where("code >= 0").select("code", "t", "most", "df").toArrow().to_pydict()
            for take in (listed, 4 * listed):
                chosen, bound, idf = set(), {}, {}
                for code in range(len(named)):
                    mine = [(np.frombuffer(t, np.uint64), np.frombuffer(m, np.float64), np.frombuffer(d, np.int64)) for k, t, m, d in zip(*lists.values(), strict=True) if k == code]
                    if not mine:
                        continue
                    t, most, d = (np.concatenate(x) for x in zip(*mine, strict=True))
                    # the last of a full list is what no other term of its range exceeds
                    cut = max([float(x[1][-1]) for x in mine if len(x[0]) >= per_range], default=0.0)
                    best = np.argsort(-most, kind="stable")
                    bound[code] = max(cut, float(most[best[take]]) if len(best) > take else 0.0)
                    best = best[:take]
                    chosen.update(t[best].tolist())
                    idf.update(zip(t[best].tolist(), (np.log((1 + n) / (1 + d[best])) + 1).tolist(), strict=True))
                sums = _sums(hashed, norms, names, np.array(sorted(chosen), np.uint64), np.array([idf[t] for t in sorted(chosen)])).collect()
                ranked = {code: sorted((r.w for r in sums if r.code == code), reverse=True)[:top] for code in bound}
                whole = all(not bound[code] or (len(ranked[code]) == top and bound[code] < ranked[code][-1] * (1 - 1e-9)) for code in bound)
                if whole:
                    break
        if whole:
            break
        listed *= 16
    order = sorted(chosen)
    last = [(r.code, order[r.place], r.w) for r in sums if r.code in ranked and r.w >= ranked[r.code][-1] * (1 - 1e-12)]
    spelled = _spelled(said.select("w", hashes), np.array(sorted({t for _, t, _ in last}), np.uint64))
    rows = [(named[code][cluster], spelled[t], w / named[code]["size"]) for code, t, w in last]
    schema = StructType([StructField(cluster, kind), StructField("term", StringType()), StructField("weight", DoubleType())])
    return top_per_group(spark.createDataFrame(rows, schema), [cluster], [F.col("weight").desc(), F.col("term")], top)


def _told(hashed: DataFrame, names: pa.Array, bounds: np.ndarray, n: int, least_docs: int, listed: int) -> DataFrame:
    """(block, part, ids, s, code, t, most, df): keys of each block, each range's sums of squares by text of a block, and lists."""
    id_kind = hashed.schema["key"].dataType
    send = StructType([StructField("part", IntegerType()), StructField("block", LongType()), *[StructField(x, BinaryType()) for x in ("t", "c", "d", "f", "codes")], StructField("ids", ArrayType(id_kind))])
    give = StructType([StructField("block", LongType()), StructField("part", IntegerType()), StructField("ids", ArrayType(id_kind)), StructField("s", BinaryType()), StructField("code", IntegerType()), *[StructField(x, BinaryType()) for x in ("t", "most", "df")]])
    send_arrow, give_arrow = to_arrow_schema(send), to_arrow_schema(give)

    def block_of(held, number):
        batch = pa.Table.from_batches(held).combine_chunks()
        ids, codes = batch.column("key").combine_chunks(), pc.fill_null(pc.index_in(batch.column("cluster"), value_set=names), -1).to_numpy().astype(np.int32)
        row, t, _, _ = _terms(batch.column("h").combine_chunks())
        order = np.argsort(t, kind="stable")
        row, t = row[order], t[order]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (row[1:] != row[:-1])])) if len(t) else np.zeros(0, np.int64)
        tf, row, t = np.diff(np.append(first, len(t))), row[first], t[first]
        new = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        each = np.diff(np.append(new, len(t)))
        keys, ends = t[new], np.append(new, len(t))
        cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
        rows = {f.name: [] for f in send_arrow}
        for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            p, q = ends[a], ends[b]
            values = (part, number, _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(each[a:b].astype(np.uint32)), _pack(row[p:q].astype(np.uint32)), _pack(tf[p:q].astype(np.uint32)), _pack(codes), None)
            for name, value in zip(rows, values, strict=True):
                rows[name].append(value)
        rows["ids"][number % len(rows["ids"])] = ids.to_pylist()
        return pa.record_batch([pa.array(rows[f.name], f.type) for f in send_arrow], schema=send_arrow)

    def blocks(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in _slices(batches):
            held.append(batch)
            size += 2 * len(batch.column("h").flatten())
            if size >= BLOCK_TERMS:
                yield block_of(held, number)
                held, size, number = [], 0, number + 1
        if held:
            yield block_of(held, number)
        del held
        pa.default_memory_pool().release_unused()

    def count(table):
        # one message after the other, as a range is large
        got = {name: table.column(name) for name in ("t", "c", "d", "f", "codes")}
        sizes = [len(x.as_buffer()) // 4 for x in got["c"]]
        keys, at = np.empty(sum(sizes), np.uint64), 0
        for x, size in zip(got["t"], sizes, strict=True):
            np.cumsum(_unpack(x, np.uint64), out=keys[at : at + size])
            at += size
        every = np.unique(keys)
        place = np.empty(len(keys), np.int32)
        df, at = np.zeros(len(every), np.int64), 0
        for x, size in zip(got["c"], sizes, strict=True):
            place[at : at + size] = np.searchsorted(every, keys[at : at + size])
            df[place[at : at + size]] += _unpack(x, np.uint32)
            at += size
        del keys
        idf = np.where(df >= least_docs, np.log((1 + n) / (1.0 + df)) + 1, 0.0)
        most = np.zeros((len(names), len(every)))
        rows, at, part = {f.name: [] for f in give_arrow}, 0, table.column("part")[0].as_py()
        for k, block in enumerate(table.column("block").to_pylist()):
            term = np.repeat(place[at : at + sizes[k]], _unpack(got["c"][k], np.uint32))
            at += sizes[k]
            doc, tf, codes = _unpack(got["d"][k], np.uint32), _unpack(got["f"][k], np.uint32), _unpack(got["codes"][k], np.int32)
            value = tf * idf[term]
            s = np.bincount(doc, weights=value**2, minlength=len(codes))
            value /= np.sqrt(np.maximum(s, 1e-300))[doc]
            of = codes[doc]
            for code in np.unique(of[of >= 0]):
                most[code] += np.bincount(term[of == code], weights=value[of == code], minlength=len(every))
            for name, value in zip(rows, (block, part, table.column("ids")[k].as_py(), s.astype(np.float64).tobytes(), -1, None, None, None), strict=True):
                rows[name].append(value)
        for code in range(len(names)):
            fit = np.flatnonzero(most[code] > 0)
            best = fit[np.argsort(-most[code][fit], kind="stable")[:listed]]
            if len(best):
                for name, value in zip(rows, (-1, part, None, None, code, every[best].tobytes(), most[code][best].tobytes(), df[best].tobytes()), strict=True):
                    rows[name].append(value)
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array(rows[f.name], f.type) for f in give_arrow], schema=give_arrow)

    # as many partitions as ranges, so that few of them share a task's sort
    return hashed.mapInArrow(blocks, send).repartition(len(bounds) + 1, "part").groupBy("part").applyInArrow(count, give)


def _norms(told: DataFrame, id_kind) -> DataFrame:
    """(key, norm) from the ranges' sums of squares."""
    schema = StructType([StructField("key", id_kind), StructField("s", DoubleType())])
    arrow = to_arrow_schema(schema)

    def add(table):
        parts = sorted(zip(table.column("part").to_pylist(), table.column("s").to_pylist(), strict=True))
        ids = next(x for x in table.column("ids").to_pylist() if x is not None)
        return pa.table([pa.array(ids, arrow.field("key").type), pa.array(np.sum([np.frombuffer(s, np.float64) for _, s in parts], axis=0))], schema=arrow)

    each = told.where("code < 0").select("block", "part", "ids", "s").groupBy("block").applyInArrow(add, schema)
    return each.groupBy("key").agg(F.sqrt(F.sum("s")).alias("norm"))


def _sums(hashed: DataFrame, norms: DataFrame, names: pa.Array, chosen: np.ndarray, idf: np.ndarray) -> DataFrame:
    """(code, place, w): sums of the chosen terms' weights by cluster."""
    id_kind = to_arrow_type(hashed.schema["key"].dataType)

    def pick(batches):
        for batch in _slices(batches):
            codes = pc.fill_null(pc.index_in(batch.column("cluster"), value_set=names), -1).to_numpy(zero_copy_only=False)
            row, t, _, _ = _terms(batch.column("h"))
            near = np.minimum(np.searchsorted(chosen, t), max(len(chosen) - 1, 0))
            hit = (chosen[near] == t) & (codes[row] >= 0) if len(chosen) else np.zeros(len(t), bool)
            found, tf = np.unique(row[hit] * max(1, len(chosen)) + near[hit], return_counts=True)
            row, place = found // max(1, len(chosen)), found % max(1, len(chosen))
            have, first = np.unique(row, return_index=True)
            ends = pa.array(np.append(first, len(row)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (place, tf)]
            yield pa.record_batch([batch.column("key").take(pa.array(have)).cast(id_kind), pa.array(codes[have].astype(np.int32)), *lists], ["k", "code", "place", "tf"])

    schema = StructType([StructField("k", hashed.schema["key"].dataType), StructField("code", IntegerType()), StructField("place", ArrayType(IntegerType())), StructField("tf", ArrayType(IntegerType()))])
    both = hashed.mapInArrow(pick, schema).join(norms, F.col("k").eqNullSafe(F.col("key"))).select("code", "place", "tf", "norm")

    def add(batches):
        w = np.zeros((len(names), len(chosen)))
        for batch in batches:
            n = batch.column("place").value_lengths().to_numpy(zero_copy_only=False)
            place, tf = (batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("place", "tf"))
            code, norm = (np.repeat(batch.column(x).to_numpy(zero_copy_only=False), n) for x in ("code", "norm"))
            w += np.bincount(code.astype(np.int64) * len(chosen) + place, weights=tf * idf[place] / norm, minlength=w.size).reshape(w.shape)
        code, place = np.nonzero(w)
        yield pa.record_batch([pa.array(code.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(w[code, place])], ["code", "place", "w"])

    return both.mapInArrow(add, "code int, place int, w double").groupBy("code", "place").agg(F.sum("w").alias("w"))


def _spelled(said: DataFrame, wanted: np.ndarray) -> dict[int, str]:
    """The words of the wanted hashes."""

    def spell(batches):
        for batch in _slices(batches):
            _, t, place, sizes = _terms(batch.column("h"))
            near = np.minimum(np.searchsorted(wanted, t), max(len(wanted) - 1, 0))
            hit = np.flatnonzero(wanted[near] == t) if len(wanted) else np.zeros(0, np.int64)
            which, first = np.unique(near[hit], return_index=True)
            flat = batch.column("w").flatten()
            terms = [" ".join(flat.slice(place[k], sizes[k]).to_pylist()) for k in hit[first]]
            yield pa.record_batch([pa.array(wanted[which].view(np.int64)), pa.array(terms, pa.string())], ["h", "term"])

    # the top terms are frequent: all are in the first texts as a rule
    for texts in (said.limit(2000), said):
        found = {r.h % (1 << 64): r.term for r in texts.mapInArrow(spell, "h long, term string").distinct().collect()}
        if len(found) == len(wanted):
            break
    return found


def central_rows(df: DataFrame, key: str, cluster: str, vector: str = "embedding", top: int = 3) -> DataFrame:
    """The rows closest to their cluster's centroid by cosine; sums by component keep the centroid distributed."""
    units = df.select(key, cluster, unit(F.col(vector)).alias("_u"))
    parts = units.select(cluster, F.posexplode("_u").alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("m"))
    centre = parts.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("_c"))
    scored = units.join(centre, cluster).select(key, cluster, dot(F.col("_u"), unit(F.col("_c"))).alias("score"))
    return top_per_group(scored, [cluster], [F.col("score").desc(), F.col(key)], top)


def described(df: DataFrame, key: str, title: str, text: str, cluster: str, stop: list[str], vector: str = "embedding", terms: int = 6, titles: int = 3, least_docs: int | None = None) -> DataFrame:
    """(cluster, size, top_terms, titles, label) of each cluster: its terms, its most central titles, its first three terms as label.

    A term is in two texts at least where there are more than 30.
    """
    if least_docs is None:
        least_docs = 2 if df.limit(31).count() > 30 else 1
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    said = cluster_terms(df, key, text, cluster, stop, terms, least_docs).groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
    central = central_rows(df, key, cluster, vector, titles).join(df.select(key, F.col(title).alias("_title")), key).groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", "_title"))).alias("_c"))
    words = F.coalesce(F.col("_t.term"), F.array().cast("array<string>"))
    named = F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 3), ", ")).otherwise("(no term)")
    full = sizes.join(said, cluster, "left").join(central, cluster, "left")
    return full.select(cluster, "size", F.array_join(words, ", ").alias("top_terms"), F.array_join("_c._title", " || ").alias("titles"), F.concat(F.lit("C"), F.col(cluster).cast("string"), F.lit(" · "), named).alias("label"))


def semantic_map(articles: DataFrame, links: DataFrame, people: DataFrame, stop: list[str], k: int | None = None, vector: str = "embedding", restarts: int = 10) -> tuple[DataFrame, DataFrame]:
    """(points, clusters): every article with x, y, cluster, its label, its people and the lab of the first that has one.

    articles: article_id, titre, annee, embedding_text and the vector; an article without a vector is an error.  links:
    chercheur_id, article_id, position; people: chercheur_id, nom_complet, laboratoire.
    """
    missing = articles.where(F.col(vector).isNull()).limit(1).count()
    if missing:
        raise ValueError("an article has no vector")
    placed = clusters(two_dimensions(articles, vector), k, vector=vector, restarts=restarts)
    told = described(placed.withColumn("_text", F.coalesce("embedding_text", "titre")), "article_id", "titre", "_text", "cluster", stop, vector)
    return map_points(placed, told, links, people), told


def map_points(placed: DataFrame, told: DataFrame, links: DataFrame, people: DataFrame, missing: str = "(non renseigné)") -> DataFrame:
    """Rows for a chart of the map, which is all that a chart needs."""
    known = links.join(people.select("chercheur_id", "nom_complet", "laboratoire"), "chercheur_id")
    lab = F.split("laboratoire", r" \| ")[0]
    each = known.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "nom_complet"))), lambda s: s["nom_complet"]), "; ").alias("chercheurs"), F.min_by(lab, F.when(F.col("laboratoire").isNotNull(), F.col("position"))).alias("laboratoire"))
    full = placed.join(told.select("cluster", F.col("label").alias("cluster_label")), "cluster").join(each, "article_id", "left")
    return full.select("article_id", "titre", "annee", "x", "y", "cluster", "cluster_label", F.coalesce("chercheurs", F.lit("")).alias("chercheurs"), F.coalesce("laboratoire", F.lit(missing)).alias("laboratoire"))
