"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints: a bit is set where over half of a text's 4-word shingle hashes (XXH64, seed 42, repeats included) set it.
Equal fingerprints are one class before anything is joined.

Candidates: the 64 bits are cut into three segments of 22, 21 and 21 bits, each padded to a word of the perfect binary
Golay code (23, 12, 7). A segment's keys are the indices of the codewords that it and its 23 neighbours decode to: one
key near a codeword, six elsewhere. Two words at distance 2 or less have a neighbour (or one of themselves) in common,
so they share a key. Of 4 errors in three segments the two segments with fewest have at most 2 each, so any two
fingerprints within 4 bits share a key in both segments of one of the three segment pairs: joined on such 24-bit keys
and verified, no link is lost.

Links: within a key all fingerprints are first held against one of them (chosen by a hash, another for each key), which
makes at most one link a row. Components are formed from these links; then every pair in a key whose members are still
in different components is verified. A group of thousands of near copies so never gives its square of pairs, and the
components are those of all links.

``near_texts`` is the same for a Jaccard similarity of word shingles, which 64 bits can't tell: 5-word shingles at 0.8
differ in 15 % of SimHash bits, so no radius that Golay keys reach holds them. There the keys come from ``TABLES`` pairs of
23-bit Golay words over 2-word shingles (which a changed word disturbs less), and the links from the distinct shingles
themselves. A text that in no key meets another one with a near sketch (5-word SimHash) is done with. Of the others each key
first holds all against its text of the commonest shingles; pairs of a key that are then in different components are found by
their rarest shingles, with the prefix and position bounds of exact set similarity joins, so that a large group of texts that
are just not alike enough gives few pairs. Sketches of ``SKETCH`` x 64 bits filter, the exact similarity of the sets decides.
No clean text is linked by a sketch; the recall of the keys is measured in the README.

Defined results: null and empty texts and texts of white space only have fingerprint zero and are linked like any other;
fewer than four words are one shingle; repeated rows share a class; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions import jvm
from landgrid.llm._util import arrow_map, materialise, remove, scratch, table
from landgrid.llm.components import components

WORDS, SEED, BITS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: the generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
TABLES = 3  # pairs of Golay words of ``near_texts``: 28 keys each
SHORT = 2  # words of the shingles that the keys are made of
SKETCH = 8
FEW = 64  # sets of fewer shingles are no normal case: they may differ in more bits
# standard deviations that a sketch of a linked pair may lie off its expected share of differing bits
SPREAD = 3.5
BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None, words: int = WORDS) -> int:
    import xxhash

    # bytes.lower() changes A-Z only and bytes.split() cuts at exactly the contract's white space
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = (np.cumsum(sizes) - sizes).tolist()
    joined = b" ".join(found)
    k = min(words, len(found))
    ends = [*(x - 1 for x in starts[k:]), len(joined)]
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(ends)
    for at in range(0, n, BLOCK):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])), np.uint64, min(BLOCK, n - at))
        total += _bit_counts(h)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of ``h`` set each bit: a histogram of each byte position, times the bits of its 256 values."""
    b = h.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(b[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def make():
        def batch(rows: pa.RecordBatch) -> dict:
            fp = np.array([fingerprint(x.as_py(), words) for x in rows.column("text")], np.uint64)
            return {"doc_id": rows.column("doc_id"), "fp": fp.view(np.int64)}

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, fp long")


def _remainder(v: np.ndarray) -> np.ndarray:
    """Of 23-bit words by the generator polynomial: 11-bit syndromes."""
    v = v.copy()
    for k in range(22, 10, -1):
        v ^= np.where(v >> k & 1, GENERATOR << (k - 11), 0)
    return v


def _leaders() -> np.ndarray:
    """The error pattern of weight 3 or less of each syndrome; the code is perfect, so there is one."""
    bit = 1 << np.arange(23, dtype=np.int64)
    i, j, k = np.meshgrid(*[np.arange(23)] * 3, indexing="ij")
    errors = np.unique(np.concatenate([[0], (bit[i] | bit[j] | bit[k]).ravel()]))
    out = np.zeros(2048, np.int64)
    out[_remainder(errors)] = errors
    return out


_LEADERS = None


def golay_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): each 23-bit word's distinct 12-bit codeword indices; one or six of them."""
    global _LEADERS
    if _LEADERS is None:
        _LEADERS = _leaders()
    near = v[:, None] ^ np.concatenate([[0], 1 << np.arange(23, dtype=np.int64)])
    index = np.sort((near ^ _LEADERS[_remainder(near)]) >> 11, axis=1)
    first = np.concatenate([np.ones((len(v), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
    rows, cols = np.nonzero(first)
    return rows, index[rows, cols]


def _words(fp: np.ndarray, segments) -> list:
    """``golay_keys`` of each segment (first bit, bits)."""
    fp = fp.astype(np.int64, copy=False).view(np.uint64)
    return [golay_keys((fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in segments]


def _combined(count: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) of ``count`` rows: for each pair of segments all combinations of their keys, marked with the pair's place."""
    rows, keys = [], []
    for p, ((ri, ki), (rj, kj)) in enumerate(pairs):
        start, n = np.searchsorted(rj, np.arange(count)), np.bincount(rj, minlength=count)
        times = n[ri]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        other = np.repeat(start[ri], times) + at
        rows.append(np.repeat(ri, times))
        keys.append(p << 24 | np.repeat(ki, times) << 12 | kj[other])
    return np.concatenate(rows), np.concatenate(keys)


def pair_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) of 64-bit fingerprints, for each pair of their segments."""
    by = _words(fp, SEGMENTS)
    return _combined(len(fp), [(by[i], by[j]) for i, j in ((0, 1), (0, 2), (1, 2))])


def table_keys(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) of fingerprints of several 64-bit words: the two low 23-bit segments of each word are a pair."""
    return _combined(len(words[0]), [_words(w, ((0, 23), (23, 23))) for w in words])


def _keyed(classes: DataFrame) -> DataFrame:
    def make():
        def batch(rows: pa.RecordBatch):
            fp = rows.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2048):
                part = fp[at : at + 2048]
                r, k = pair_keys(part)
                yield {"key": k, "fp": part[r]}

        return batch

    return arrow_map(classes.select("fp"), make, "key int, fp long")


def fingerprint_components(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """Distinct fp -> (fp, root) of every fingerprint that has a link."""
    keyed = materialise(_keyed(classes), "golay-keys")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= bits
    shared = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp", "key").alias("h"), F.col("fp"))).alias("m"), F.count("*").alias("n"))
    pivots = shared.where("n > 1").select(F.col("key").alias("k"), F.col("m.fp").alias("pivot"))
    stars = keyed.join(pivots.hint("merge"), (F.col("key") == F.col("k")) & (F.col("fp") != F.col("pivot")) & near(F.col("fp"), F.col("pivot")))
    stars = materialise(stars.select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    found = materialise(components(stars), "star-components").withColumnsRenamed({"node": "fp", "component_id": "root"})
    # what the pivots missed: pairs in a key that are not in one component yet
    rooted = keyed.join(found.hint("merge"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    x, y = (rooted.select("key", F.col("fp").alias(f"{s}_fp"), F.col("root").alias(f"{s}_root")).hint("merge") for s in "xy")
    rest = x.join(y, "key").where((F.col("x_root") < F.col("y_root")) & near(F.col("x_fp"), F.col("y_fp")))
    rest = materialise(rest.select(F.col("x_root").alias("a"), F.col("y_root").alias("b")).distinct(), "rest")
    if rest.isEmpty():
        return found
    star = found.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b"))
    return components(star.union(rest)).select(F.col("node").alias("fp"), F.col("component_id").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row: the smallest doc_id reachable by links of ``bits`` or fewer bits."""
    rows = materialise(fingerprints(docs, words), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = classes.join(fingerprint_components(classes, bits), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = found.select("fp", "root").join(first, "root").select("fp", "component_id")
    # hash joins of a class with all its rows: the rows' side may be dealt out anew where one class is hot
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def differing(similarity: float, bits: int, few: bool = True) -> int:
    """Most bits by which sketches of two equally long texts of that Jaccard similarity differ, ``SPREAD`` deviations above the mean.

    The mean is the angle of their shingle sets over pi; where sets may have ``few`` shingles it is 1/5 at least.
    """
    p = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, 0.2 if few and similarity < 1 else 0)
    return min(bits, math.ceil(bits * p + SPREAD * math.sqrt(bits * p * (1 - p))))


def _hashed(spark: SparkSession, name: str, *args):
    kinds = {"lg_shingles": ("landgrid.llm.ShingleHash$Set", "array<bigint>"), "lg_sketch": ("landgrid.llm.ShingleHash$Sketch", "array<bigint>")}
    jvm.register(spark, Path(__file__).parent / "java" / "ShingleHash.java", kinds)
    return F.call_function(name, *args)


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, digest (of the text), n and id (count and hash of the distinct shingles), sketch, keys (fingerprint words of ``SHORT`` words)."""
    call = lambda k, n: _hashed(docs.sparkSession, "lg_sketch", F.col("text"), F.lit(k), F.lit(n))
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), call(words, SKETCH).alias("s"), call(SHORT, TABLES).alias("k"))
    part = lambda c, n: F.slice(c, 3, n)
    return rows.select("doc_id", "digest", F.element_at("s", 1).alias("n"), F.element_at("s", 2).alias("id"), part("s", SKETCH).alias("sketch"), part("k", TABLES).alias("keys"))


def _table_keyed(classes: DataFrame) -> DataFrame:
    """key, id, s, t: a row a key, with two words of the sketch to tell chance meetings by."""

    def make():
        def batch(rows: pa.RecordBatch):
            ids, s, t = (rows.column(c).to_numpy(zero_copy_only=False) for c in "ist")
            words = [rows.column(f"k{i}").to_numpy(zero_copy_only=False) for i in range(TABLES)]
            for at in range(0, len(ids), 2048):
                part = slice(at, at + 2048)
                r, k = table_keys([w[part] for w in words])
                yield {"key": k, "id": ids[part][r], "s": s[part][r], "t": t[part][r]}

        return batch

    cols = [F.element_at("keys", i + 1).alias(f"k{i}") for i in range(TABLES)]
    return arrow_map(classes.select(F.col("id").alias("i"), *(F.element_at("sketch", j + 1).alias(x) for j, x in enumerate("st")), *cols), make, "key int, id long, s long, t long")


def _apart(x, y):
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)


def _met(classes: DataFrame, similarity: float) -> DataFrame:
    """key, id: the keys in which a text meets another one that two words of its sketch don't tell apart. At most a row a key of a text."""
    spark, path = classes.sparkSession, scratch(classes.sparkSession, "table-keys")
    _table_keyed(classes).write.parquet(path)
    keyed = spark.read.schema("key int, id long, s long, t long").parquet(path)
    bits = lambda c: F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    near = (F.col("x.id") != F.col("y.id")) & (bits("s") + bits("t") <= differing(similarity, 128))
    # both sides have the same columns, so the second one reuses the first one's exchange
    met = keyed.alias("x").join(keyed.hint("merge").alias("y"), (F.col("x.key") == F.col("y.key")) & near, "left_semi")
    met = materialise(met.select("key", "id"), "met")
    remove(spark, path)  # the largest table that is written here; nothing reads it again
    return met


def _ordered_sets(met: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """id, n, sketch, set, common: the distinct shingles of texts that meet others, rarest among those texts first, and their mean log count."""
    needed = met.select("id").distinct().join(classes.select("id", "doc_id", "digest", "n", "sketch"), "id")
    texts = docs.select(F.col("doc_id").alias("d"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("g"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))
    texts = needed.join(texts, same).groupBy("id").agg(*(F.first(c).alias(c) for c in ("n", "sketch", "text")))
    sets = materialise(texts.select("id", "n", "sketch", _hashed(docs.sparkSession, "lg_shingles", F.col("text"), F.lit(words)).alias("set")), "shingles")
    single = sets.select("id", F.explode("set").alias("token"))
    counted = single.join(single.groupBy("token").agg(F.count("*").alias("c")).hint("merge"), "token")
    ordered = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("o"), F.avg(F.log("c")).alias("common"))
    return sets.drop("set").join(ordered, "id").select("id", "n", "sketch", F.col("o.token").alias("set"), "common")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of ids -> those whose distinct shingles have that Jaccard similarity; sketches go before sets."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    most = F.when(F.least("na", "nb") < FEW, differing(similarity, 64 * SKETCH)).otherwise(differing(similarity, 64 * SKETCH, few=False))
    sized = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(sized & (_apart("sa", "sb") <= most)).select("a", "b")
    full = lambda x, c: sets.select(F.col("id").alias(x), F.col("set").alias(c))
    both = close.join(full("a", "x"), "a").join(full("b", "y"), "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return both.where(F.col("i") >= (F.col("n") - F.col("i")) * similarity - 1e-9).select("a", "b")


def _stars(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): each text with the one of its key whose shingles are the commonest, mostly the text that a group was copied from."""
    ranked = met.join(sets.select("id", "common"), "id")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("common", F.col("id").alias("b"))).alias("m")).select(F.col("key").alias("k"), F.col("m.b").alias("b"))
    stars = met.join(pivots.hint("merge"), (F.col("key") == F.col("k")) & (F.col("id") != F.col("b")))
    return stars.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def _rest(met: DataFrame, sets: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of different components that share a key and may still have the similarity.

    Texts of n shingles that have it share s x n at least, so each has one of the shared among its n - s x n + 1 rarest; at the
    first one that they share, what follows in both must suffice for the overlap that is due. Both bounds are exact.
    """
    keys = met.groupBy("id").agg(F.collect_set("key").alias("keys"))  # of one text: 28 x TABLES at most
    due = F.ceil(F.col("n") * similarity - 1e-9).cast("int")
    head = sets.select("id", "n", F.posexplode(F.slice("set", F.lit(1), F.col("n").cast("int") - due + 1)).alias("at", "token"))
    head = head.join(found.hint("merge"), "id", "left").select("id", "token", (F.col("n") - F.col("at")).alias("left"), "n", F.coalesce("root", "id").alias("root"))
    head = materialise(head, "rare-shingles")
    x, y = (head.toDF(a, "token", f"left_{a}", f"n_{a}", f"root_{a}").hint("merge") for a in "ab")
    enough = F.least("left_a", "left_b") >= (F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - 1e-9
    pairs = x.join(y, (x["token"] == y["token"]) & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & enough).select("a", "b").distinct()
    pairs = pairs.join(keys.toDF("a", "ka"), "a").join(keys.toDF("b", "kb"), "b")
    return pairs.where(F.arrays_overlap("ka", "kb")).select("a", "b")


def near_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, digest (SHA-256 of the text), component (a long), kept: components of links by shingle similarity.

    Kept is the row of the smallest doc_id of a component (null ids last, then the smallest digest); rows that are alike in
    both are kept or not together. Texts without words are one class; shingles count once; texts with equal
    shingle sets are one class by a 64-bit hash of the set. An empty table gives an empty result.
    """
    rows = materialise(sketches(docs, words), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    classes = rows.groupBy("id").agg(F.min(order).alias("f"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    classes = materialise(classes.select("id", "f.doc_id", "f.digest", "n", "sketch", "keys"), "text-classes")
    met = _met(classes, similarity)
    sets = materialise(_ordered_sets(met, classes, docs, words), "ordered-shingles")
    stars = materialise(_verified(_stars(met, sets), sets, similarity), "stars")
    found = materialise(components(stars), "star-components").withColumnsRenamed({"node": "id", "component_id": "root"})
    rest = materialise(_verified(_rest(met, sets, found, similarity), sets, similarity), "rest")
    if not rest.isEmpty():
        found = components(stars.union(rest)).withColumnsRenamed({"node": "id", "component_id": "root"})
    whole = rows.join(materialise(found, "text-components"), "id", "left").select("doc_id", "digest", F.coalesce("root", "id").alias("component"))
    first = whole.groupBy("component").agg(F.min(order).alias("f"))
    same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("digest") == F.col("f.digest"))
    return whole.join(first, "component").select("doc_id", "digest", "component", same.alias("kept"))


def kept_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the rows that ``near_texts`` does not keep; only the ids and digests of those are joined with the texts."""
    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name
    goes = near_texts(docs, words, similarity).where("NOT kept").select(F.col("doc_id").alias(f"d{free}"), F.col("digest").alias(f"g{free}")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(f"d{free}")) & (F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) == F.col(f"g{free}"))
    return docs.join(goes, same, "left_anti")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
