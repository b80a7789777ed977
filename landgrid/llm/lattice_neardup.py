"""Embedding near-dedup by lattice hashing.

Each of ``TABLES`` tables projects the unit vector on eight random orthonormal directions, scales by 1/``WIDTH`` and
decodes the nearest point of the E8 lattice; that point names the vector's cell. A vector looks into its own cell and
the ``PROBES`` neighbouring cells (of the 240 minimal vectors) that its residual leans to most. Rows of this index are a
cell, an id and a 128-bit sign sketch; a pair that meets in a cell goes on if its sketches differ in at most
``SKETCH_BITS`` bits (over six standard deviations above the mean at the threshold), is made distinct over tables and is
verified by cosine in double precision. Every row is indexed and every row is a query.

Equal vectors are one class from the start, with its count of rows: copies are never paired with each other.

Parameters: at cosine 0.95 in 64 dimensions the recall of these four tables, measured on 4,000 vectors, is 0.99 (see
the tests); it is higher for closer pairs.

Defined results: one row comes back for each row, whatever its vec_id. Vectors that are null, empty, zero, of another length than
the one the caller names (``dim``), or with null or non-finite components link with nothing; repeated rows with one
vec_id count as one each in n_links; different vectors with one vec_id are vectors of their own; a null vec_id is the smallest of its
component only if all are null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm._util import arrow_map, materialise, table
from landgrid.llm.components import components

TABLES, WIDTH, PROBES, SEED = 4, 0.13, 8, 7
SKETCH_BITS, THRESHOLD = 34, 0.95


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: (+-2, +-2, 0...) and (+-1)^8 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [s for s in itertools.product((-1, 1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out, np.int64)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: the worst-rounded coordinate goes the other way where the sum is odd."""
    r = np.rint(x)
    e = x - r
    odd = np.flatnonzero(r.sum(1) % 2)
    k = np.abs(e[odd]).argmax(1)
    r[odd, k] += np.where(e[odd, k] >= 0, 1, -1)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row, doubled so that it is integer."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], a, b)).astype(np.int64)


class Lattice:
    def __init__(self, dim: int, tables: int = TABLES, width: float = WIDTH, probes: int = PROBES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        k = min(8, dim)
        self.maps = []
        for _ in range(tables):
            q = np.linalg.qr(rng.standard_normal((dim, k)))[0]
            self.maps.append(np.pad(q, ((0, 0), (0, 8 - k))) / width)
        self.planes = rng.standard_normal((dim, 128))
        self.minimal, self.probes = minimal_vectors(), probes

    @staticmethod
    def _key(t: int, points: np.ndarray) -> np.ndarray:
        """Table and point in one long: seven bits a coordinate, which unit vectors over WIDTH stay well within."""
        key = np.full(points.shape[:-1], t, np.int64)
        for j in range(8):
            key = key << 7 | (points[..., j] + 64 & 127)
        return key

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x tables) own cells and (rows x tables x probes) neighbouring ones."""
        own, near = [], []
        for t, m in enumerate(self.maps):
            x = unit @ m
            point = decode_e8(x)
            lean = (x - point / 2) @ self.minimal.T
            best = np.argpartition(-lean, self.probes, axis=1)[:, : self.probes]
            own.append(self._key(t, point))
            near.append(self._key(t, point[:, None, :] + self.minimal[best]))
        return np.stack(own, 1), np.stack(near, 1)

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.planes > 0, axis=1).view(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def is_usable(dim: int) -> Column:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size("embedding") == dim) & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where(is_usable(dim))


def _index(classes: DataFrame, dim: int, lattice: tuple) -> DataFrame:
    def make():
        e8 = Lattice(dim, *lattice)

        def batch(rows: pa.RecordBatch):
            ids, m = rows.column("id").to_numpy(), _matrix(rows.column("embedding"), dim)
            for at in range(0, len(ids), 1024):
                x = m[at : at + 1024]
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                own, near = e8.cells(x)
                s, n, per = e8.sketches(x), len(x), own.shape[1] * (1 + near.shape[2])
                cell = np.concatenate([own, near.reshape(n, -1)], axis=1).ravel()
                is_own = np.tile(np.arange(per) < own.shape[1], n)
                yield {"cell": cell, "id": np.repeat(ids[at : at + 1024], per), "own": is_own, "s1": np.repeat(s[:, 0], per), "s2": np.repeat(s[:, 1], per)}

        return batch

    return arrow_map(classes.select("id", "embedding"), make, "cell long, id long, own boolean, s1 long, s2 long")


def links(classes: DataFrame, dim: int, threshold: float = THRESHOLD, lattice: tuple = ()) -> DataFrame:
    """(id, embedding) distinct vectors -> (a, b) with a < b of cosine ``threshold`` or more."""
    index = materialise(_index(classes, dim, lattice), "lattice-index")
    x = index.where("own").select("cell", F.col("id").alias("x"), F.col("s1").alias("x1"), F.col("s2").alias("x2"))
    y = index.select("cell", F.col("id").alias("y"), "own", F.col("s1").alias("y1"), F.col("s2").alias("y2"))
    apart = F.bit_count(F.col("x1").bitwiseXOR(F.col("y1"))) + F.bit_count(F.col("x2").bitwiseXOR(F.col("y2")))
    # two own rows of a cell meet once; an own row and a probing row meet whichever is smaller
    met = x.join(y.hint("merge"), "cell").where((F.when(F.col("own"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))) & (apart <= SKETCH_BITS))
    pairs = materialise(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "candidates")
    v = classes.select(F.col("id"), F.col("embedding"))
    both = pairs.join(v.select(F.col("id").alias("a"), F.col("embedding").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("embedding").alias("vb")), "b")

    def make():
        def batch(rows: pa.RecordBatch) -> dict:
            p, q = _matrix(rows.column("va"), dim), _matrix(rows.column("vb"), dim)
            cos = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
            keep = pa.array(cos >= threshold)
            return {c: rows.column(c).filter(keep) for c in ("a", "b")}

        return batch

    return arrow_map(both, make, "a long, b long")


def near_duplicates(vectors: DataFrame, dim: int = 64, threshold: float = THRESHOLD, lattice: tuple = ()) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for every row.

    A class of equal vectors has a number of its own, so different vectors may share a vec_id.
    """
    rows = vectors.select("vec_id", "embedding")
    good = usable(rows, dim)
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    found = materialise(links(classes, dim, threshold, lattice), "vector-links")
    both = found.union(found.select("b", "a")).toDF("id", "other")
    others = both.join(classes.select(F.col("id").alias("other"), F.col("n").alias("m")), "other").groupBy("id").agg(F.sum("m").alias("m"))
    info = classes.select("id", "first_id", "n").join(others, "id", "left").join(components(found).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("component_id", "id"))
    first = info.groupBy("root").agg(F.min("first_id").alias("smallest"))
    info = info.join(first, "root").select("id", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.col("smallest").alias("component_id"))
    member = good.join(classes.select("embedding", "id"), "embedding").select("vec_id", "id").join(info, "id").select("vec_id", "n_links", "component_id")
    rest = rows.where(~is_usable(dim)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, m) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.m FROM r JOIN l ON r.a = l.a),
c AS (SELECT a, min(m) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
