"""Near-duplicate vectors of one label by product quantisation.

1. One pass checks the vectors; equal vectors of one label are folded into one class
   with a partially aggregated shuffle by digest, so copies are never compared.
2. On a sample of at most ``SAMPLE`` classes (drawn by hash) NumPy fits unit centroids of
   the coarse lists and, on the residuals, a codebook for each stretch of ``SUB``
   components. Both have fixed bounds and are all that is broadcast.
3. Every class is indexed: the list of its nearest centroid, its residual code, and the
   length ``err`` of what the code misses.
4. *Probes.* With radius r = sqrt(2 - 2 * cosine), a partner y of x lies in another list
   only if it is nearer to that list's centroid, so x is at most r from the plane between
   both centroids. A class probes every list whose plane is within r * min(1, SPREAD /
   sqrt(d)), d the effective dimension of the residuals: all that can hold a partner if d is
   at most SPREAD^2, else SPREAD standard deviations of an even displacement. There is no
   cap on probes, list lengths or partners.
5. *Search.* In a list each query adds up inner products of a table (its stretches by
   codewords) for all codes. A member stays if that distance is at most r + err, which by the
   triangle inequality loses no partner; then the exact cosine decides. Lists are dealt
   into blocks of ``BLOCK`` members and ``BLOCK`` queries, so a hot list is many groups.
   A group gives a count and one edge a vector, not its pairs. A pair that both lists'
   probes meet is counted from the list with the smaller number.
6. Counts are summed; edges go through connected components.

Recall over all pairs is measured in the tests (1.0 on the given tables).

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and vectors of a null label, link with nothing and are components of their own; vectors of
different length never link; repeated rows (equal vec_id and vector) are vectors that link
with each other; a null vec_id is never the smallest of a component with another id, and is
kept only where no id is; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from behaviorframe.llm._common import drop, keep, pick
from behaviorframe.llm._memo import claim
from behaviorframe.llm.components import components

COSINE = 0.98
#: Classes that the index is fitted on, and bytes that these may have; classes a coarse list at least in the sample; lists at most (longer lists cost time, not results).
SAMPLE, SAMPLE_BYTES, FOR_A_LIST, LISTS = 65_536, 64 << 20, 32, 2048
#: Components a stretch; codewords of a stretch; rounds of k-means; standard deviations of a displacement that probes allow for.
SUB, CODES, ROUNDS, SPREAD = 4, 256, 8, 4.0
#: Members and queries of a group at most; queries that are looked up together.
BLOCK, CHUNK = 1024, 256


class Index(NamedTuple):
    centroids: np.ndarray  # lists x dim, unit length
    books: np.ndarray  # stretches x codewords x SUB
    margin: float
    radius: float
    cosine: float


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)  # no overflow, no vanishing squares
    return x / np.sqrt(np.einsum("...i,...i->...", x, x))[..., None]


def _nearest(x: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    half = 0.5 * np.einsum("ij,ij->i", centres, centres)
    return np.concatenate([np.argmax(x[k : k + rows] @ centres.T - half, axis=1) for k in range(0, len(x), rows)]) if len(x) else np.zeros(0, np.int64)


def _k_means(x: np.ndarray, k: int, draw: np.random.Generator, unit: bool = False) -> np.ndarray:
    centres = x[np.sort(draw.permutation(len(x))[:k])].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        size = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(size)
        centres[full] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(size[full])[:-1]]), axis=0) / size[full, None]
        if unit:
            length = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(length > 1e-9, centres / np.maximum(length, 1e-9), x[: len(centres)])
    return centres


def fit(sample: np.ndarray, rows: int, cosine: float = COSINE, seed: int = 11) -> Index:
    """Coarse centroids and residual codebooks of unit vectors (padded to whole stretches); about the root of all rows as many lists."""
    draw = np.random.Generator(np.random.PCG64(seed))
    lists = max(1, min(LISTS, math.isqrt(rows), len(sample) // FOR_A_LIST))
    centroids = _unit(_k_means(sample, lists, draw, unit=True))
    rest = sample - centroids[np.argmax(sample @ centroids.T, axis=1)]
    parts = rest.reshape(len(rest), -1, SUB)
    books = np.stack([_k_means(parts[:, m], min(CODES, len(parts)), draw) for m in range(parts.shape[1])])
    spectrum = np.linalg.eigvalsh(np.cov(rest.T)) if len(rest) > 1 else np.zeros(1)
    squares = float((spectrum**2).sum())
    dims = float(spectrum.sum()) ** 2 / squares if squares > 0 else 1.0
    radius = math.sqrt(2 - 2 * cosine)
    return Index(centroids, books, radius * min(1.0, SPREAD / math.sqrt(dims)), radius, cosine)


def _decoded(vecs: pd.Series, width: int, kind: str) -> np.ndarray:
    """Unit vectors in double precision; shorter ones are padded with zeros, which changes no distance."""
    out = np.zeros((len(vecs), width))
    for k, v in enumerate(vecs):
        own = np.frombuffer(v, kind)
        out[k, : len(own)] = own
    return _unit(out) if len(out) else out


def _valid(kind: str):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for v, label in zip(b["vec"], b["label"]):
                v = None if v is None or label is None else np.asarray(v, kind) + np.asarray(0, kind)  # no negative zero
                if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    rows.append((0, None, None))
                else:
                    rows.append((len(v), hashlib.sha256(v.tobytes()).digest(), v.tobytes()))
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], **dict(zip(("dim", "digest", "vec"), map(list, zip(*rows)) if rows else ([], [], [])))})

    return check


def _indexed(index: Index, width: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("embedding_dedup")
        c = index.centroids
        apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
        for b in batches:
            for low in range(0, len(b), 2048):
                part = b.iloc[low : low + 2048]
                x = _decoded(part["vec"], width, kind)
                inner = x @ c.T
                home = np.argmax(inner, axis=1)
                rest = x - c[home]
                own = rest.reshape(len(x), -1, SUB)
                codes = np.stack([_nearest(own[:, m], book) for m, book in enumerate(index.books)], axis=1).astype(np.uint8)
                coded = np.concatenate([book[codes[:, m]] for m, book in enumerate(index.books)], axis=1)
                whole = c[home] + coded
                near = inner[np.arange(len(x)), home][:, None] - inner <= index.margin * apart[home]
                near[np.arange(len(x)), home] = True
                yield part[["rid", "label", "dim", "n", "vec"]].assign(
                    home=home.astype(np.int32), probes=[np.flatnonzero(p).astype(np.int32) for p in near], code=[x.tobytes() for x in codes],
                    err=np.linalg.norm(rest - coded, axis=1), square=np.einsum("ij,ij->i", whole, whole),
                )

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of n nodes the smallest that each reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(query: pd.DataFrame, member: pd.DataFrame, index: Index, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked (query, member) pairs: table look-ups, then exact cosines."""
    q, y = _decoded(query["vec"], width, kind), _decoded(member["vec"], width, kind)
    codes = np.stack([np.frombuffer(x, np.uint8) for x in member["code"]])
    far = (index.radius + member["err"].to_numpy() + 1e-4) ** 2
    centre = index.centroids[int(member["home"].iloc[0])]
    base = 1 + member["square"].to_numpy()
    out_q, out_y = [], []
    for low in range(0, len(q), CHUNK):
        x = q[low : low + CHUNK]
        tables = np.einsum("qms,mks->mqk", x.reshape(len(x), -1, SUB), index.books, optimize=True).astype(np.float32)
        inner = np.zeros((len(x), len(y)), np.float32)
        for m in range(codes.shape[1]):
            inner += tables[m][:, codes[:, m]]
        at_q, at_y = np.nonzero(base - 2 * (x @ centre)[:, None] - 2 * inner <= far)
        for k in range(0, len(at_q), 1 << 16):
            a, b = at_q[k : k + (1 << 16)], at_y[k : k + (1 << 16)]
            hit = np.einsum("ij,ij->i", x[a], y[b]) >= index.cosine
            out_q.append(a[hit] + low)
            out_y.append(b[hit])
    return (np.concatenate(out_q), np.concatenate(out_y)) if out_q else (np.zeros(0, np.int64),) * 2


_FOUND = "rid long, links long, root long"


def _search(index: Index, width: int, kind: str):
    empty = pd.DataFrame({"rid": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})

    def run(g: pd.DataFrame) -> pd.DataFrame:
        claim("embedding_dedup")
        is_query = g["query"].to_numpy(bool)
        query, member = g[is_query], g[~is_query]
        if not len(query) or not len(member) or len(query) == len(member) == 1 and query["rid"].iloc[0] == member["rid"].iloc[0]:
            return empty
        a, b = _links(query, member, index, width, kind)
        rid_q, rid_y, home = query["rid"].to_numpy(), member["rid"].to_numpy(), query["home"].to_numpy()
        here = int(member["home"].iloc[0])
        own = home[a] == here
        use = rid_q[a] != rid_y[b]
        if (home[a] > here).any():  # the member's own probes of the query's list come first
            flat = np.concatenate([np.asarray(p) for p in member["probes"]])
            row = np.repeat(np.arange(len(member)), [len(p) for p in member["probes"]])
            told = np.unique(row.astype(np.int64) * len(index.centroids) + flat)
            use &= ~((home[a] > here) & np.isin(b.astype(np.int64) * len(index.centroids) + home[a], told))
        a, b, own = a[use], b[use], own[use]
        if not len(a):
            return empty
        n_q, n_y = query["n"].to_numpy(), member["n"].to_numpy()
        nodes, place = np.unique(np.concatenate([rid_q[a], rid_y[b]]), return_inverse=True)
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, place[: len(a)], n_y[b])  # within a list each of both asks for itself
        np.add.at(links, place[len(a) :], np.where(own, 0, n_q[a]))
        return pd.DataFrame({"rid": nodes, "links": links, "root": nodes[_forest(place[: len(a)], place[len(a) :], len(nodes))]})

    return run


def _dealt(entries: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Members and queries of every list in groups of at most about ``block`` of each, and the written table of lists that are more than one group."""
    group = ["label", "dim", "list"]
    columns = ["rid", "home", "n", "vec", "code", "err", "square", "probes"]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("code", "binary"), ("err", "double"), ("square", "double"), ("probes", "array<int>"))]
    members = entries.select("label", "dim", F.col("home").alias("list"), *columns, F.lit(False).alias("query"))
    queries = entries.select("label", "dim", F.explode("probes").alias("list"), *columns[:4], *nothing, F.lit(True).alias("query"))
    sizes = [x.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(c)) for x, c in ((members, "of_members"), (queries, "of_queries"))]
    large = keep(sizes[0].join(sizes[1], group).where("of_members > 1 OR of_queries > 1"), "large_lists")  # every member asks its own list
    if large.isEmpty():
        return members.unionByName(queries).withColumns({"m": F.lit(0), "q": F.lit(0)}), large
    at = lambda c: F.pmod(F.xxhash64("rid"), F.coalesce(c, F.lit(1))).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    members = members.join(large, group, "left").withColumns({"m": at(F.col("of_members")), "q": each(F.col("of_queries"))})
    queries = queries.join(large, group, "left").withColumns({"q": at(F.col("of_queries")), "m": each(F.col("of_members"))})
    return members.unionByName(queries), large


def embedding_dedup(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """A row a vector: vec_id, n_links, component_id, kept."""
    kind = "f4" if vectors.schema[vectors.columns.index(vec_col)].dataType.elementType == T.FloatType() else "f8"
    id_type = vectors.schema[vectors.columns.index(id_col)].dataType.simpleString()
    named = pick(vectors, id_col, label_col, vec_col).toDF("vec_id", "label", "vec").select("vec_id", F.col("label").cast("string").alias("label"), F.col("vec").cast("array<float>" if kind == "f4" else "array<double>").alias("vec"))
    named = named.withColumn("vec", F.when(~F.exists("vec", lambda x: x.isNull()), F.col("vec")))
    rows = keep(named.mapInPandas(_valid(kind), f"vec_id {id_type}, label string, dim int, digest binary, vec binary"), "vectors")
    key = ["label", "dim", "digest"]
    classes = rows.where("digest IS NOT NULL").groupBy(*key).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = keep(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")
    alone = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    many, dim = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not many:
        return alone
    width = -(-dim // SUB) * SUB
    most = max(1, min(sample, SAMPLE_BYTES // (8 * width)))
    drawn = classes.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < int(min(1.0, 1.2 * most / many) * (1 << 30)) + 1).select("vec").limit(most).toPandas()
    index = fit(_decoded(drawn["vec"], width, kind) if len(drawn) else np.eye(1, width), many, cosine)
    entries = classes.select("rid", "label", "dim", "n", "vec").mapInPandas(
        _indexed(index, width, kind), "rid long, label string, dim int, n long, vec binary, home int, probes array<int>, code binary, err double, square double"
    )
    entries = keep(entries, "entries")
    dealt, large = _dealt(entries, block)
    found = keep(dealt.groupBy("label", "dim", "list", "m", "q").applyInPandas(_search(index, width, kind), _FOUND), "links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = components(found.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rid"), F.col("label").alias("component"))
    told = classes.select("rid", *key, "least", "n").join(links, "rid", "left").join(joined, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = keep(told.join(least, "component").select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "told")
    own = rows.where("digest IS NOT NULL").select("vec_id", *key).join(told, key)
    out = keep(own.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone), "vectors_told")
    for table in (rows, classes, entries, large, found, told):
        drop(table)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


NAME = "op11_embedding_dedup"
ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
r(x, y) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
