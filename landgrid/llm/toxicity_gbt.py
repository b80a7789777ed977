"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a small fixed lexicon and of a lexicon learned from labelled rows (words and four-letter
word starts that occur in clearly more toxic documents than others), the strongest learned weights, how close hits stand
to second-person words, capitals, punctuation, digits and obfuscated spellings (letters mixed with digits or symbols are
read with the letters they imitate), and length.

Fit: on at most ``SAMPLE_ROWS`` labelled documents that are not held out, those with the smallest hash of doc_id. Word
counts are made by Spark; only lexicons of at most ``LEXICON`` entries and one row of features a sampled document come
to the driver. A training document's features use the lexicon of the other half, so that chance words do not look
strong. A quarter of the sample calibrates.

Defined results: null and empty texts have all-zero features and a score like any other; repeated labels count each;
without labels of both kinds every score is the share of label 1 (0 if there is none); extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from landgrid.llm._util import arrow_map, table

SAMPLE_ROWS, LEXICON, THRESHOLD = 20_000, 6_000, 0.7
MIN_WEIGHT, START = 1.5, 4
KEPT_WORDS, SLICE = 120_000, 1 << 18
# Common English insults and second-person words of four languages.
INSULTS = frozenset("idiot idiots moron morons stupid scum loser losers trash worthless pathetic disgusting clown clowns dumb jerk garbage vermin filth filthy hate kill bastard fool fools imbecile freak ugly".split())
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ihnen usted ustedes ti tú tus vosotros vuestro os".split())
_WORDS = re.compile(r"[\w@$*]+(?:['’][\w@$*]+)*")
_LEET = str.maketrans("013457@$!*", "oieastasi ")
NAMES = ["fixed_density", "learned_density", "learned_top", "learned_sum", "starts_density", "starts_top", "near_second", "second_density", "caps", "bang", "question", "punct", "digits", "obfuscated", "log_words", "fixed_hits", "learned_hits"]


class Features:
    """Word codes are kept: learned weight, start weight and kinds of each word seen."""

    def __init__(self, words: dict[str, float], starts: dict[str, float]):
        self.words, self.starts = words, starts
        self.kept: dict[str, int] = {}
        self.table = np.zeros((1024, 5))  # learned weight, start weight, fixed, second person, obfuscated

    def _code(self, word: str) -> list[float]:
        plain = word.translate(_LEET).replace(" ", "")
        odd = plain != word and any(c.isalpha() for c in word)
        w = max(self.words.get(word, 0.0), self.words.get(plain, 0.0) if odd else 0.0)
        s = self.starts.get(word[:START], 0.0) if len(word) > START else 0.0
        return [w, s, float(word in INSULTS or plain in INSULTS), float(word in SECOND_PERSON), float(odd)]

    def _rows(self, words: list[str]) -> np.ndarray:
        kept, get, out = self.kept, self.kept.get, []
        rare: list[list[float]] = []
        for w in words:
            k = get(w)
            if k is None:
                code = self._code(w)
                k = len(kept)
                if k < KEPT_WORDS:
                    if k >= len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.table[k] = code
                    kept[w] = k
                else:
                    rare.append(code)
                    k = -len(rare)
            out.append(k)
        at = np.array(out, np.int64)
        rows = self.table[np.maximum(at, 0)]
        if rare:
            rows[at < 0] = np.array(rare)[-at[at < 0] - 1]
        return rows

    def of(self, text: str | None) -> np.ndarray:
        text = text or ""
        n, sums, tops, near = 0, np.zeros(5), np.zeros(2), 0.0
        hits, raw = np.zeros(2), np.zeros(256, np.int64)
        for at in range(0, len(text), SLICE):
            part = text[at : at + SLICE]
            raw += np.bincount(np.frombuffer(part.encode(), np.uint8), minlength=256)
            if not (words := _WORDS.findall(part.lower())):
                continue
            r = self._rows(words)
            n += len(words)
            sums += r.sum(0)
            tops = np.maximum(tops, r[:, :2].max(0))
            hit = (r[:, 2] > 0) | (r[:, 0] > 0)
            hits += ((r[:, 0] > 0).sum(), (r[:, 1] > 0).sum())
            if hit.any() and (you := np.flatnonzero(r[:, 3])).size:
                h = np.flatnonzero(hit)
                k = np.searchsorted(you, h)
                gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - h), np.abs(you[np.maximum(k - 1, 0)] - h))
                near += float((1.0 / (1.0 + gap)).sum())
        m, chars = max(n, 1), max(int(raw.sum()), 1)
        letters = max(int(raw[65:91].sum() + raw[97:123].sum()), 1)
        punct = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
        return np.array([sums[2] / m, hits[0] / m, tops[0], np.log1p(sums[0]), hits[1] / m, tops[1], near / m, sums[3] / m, raw[65:91].sum() / letters, raw[33] / chars, raw[63] / chars, punct / chars, raw[48:58].sum() / chars, sums[4] / m, np.log1p(n), np.log1p(sums[2]), np.log1p(hits[0])])


class Boosted:
    """Logistic gradient boosting on binned features; trees of fixed depth in arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0):
        self.depth, self.rate = depth, rate
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        self.trees = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self._tree(b, y - p, np.maximum(p * (1 - p), 1e-9), bins, ridge)
            f += rate * tree[2][leaf]
            self.trees.append(tree)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, ridge: float) -> tuple:
        n, features = b.shape
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(2**self.depth, np.int64), np.full(2**self.depth, bins)
        for level in range(self.depth):
            width = 2**level
            best = np.full(width, 1e-6)
            pick, at = np.zeros(width, np.int64), np.full(width, bins)
            for j in range(features):
                cell = node * (bins + 1) + b[:, j]
                gl = np.bincount(cell, g, width * (bins + 1)).reshape(width, -1).cumsum(1)
                hl = np.bincount(cell, h, width * (bins + 1)).reshape(width, -1).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                pick, at = np.where(better, j, pick), np.where(better, k, at)
            feature[width : 2 * width], cut[width : 2 * width] = pick, at
            node = node * 2 + (b[np.arange(n), pick[node]] > at[node])
        leaves = 2**self.depth
        value = np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + ridge)
        return (feature, cut, value), node

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._bin(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            f += self.rate * value[node - 2**self.depth]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the best non-decreasing fit; equal x are pooled first."""
    u, at = np.unique(x, return_inverse=True)
    w, s = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []  # sum, weight, first knot, last knot
    for k, (a, b) in enumerate(zip(s, w)):
        blocks.append([a, b, k, k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a2, b2, _, last = blocks.pop()
            blocks[-1][0] += a2
            blocks[-1][1] += b2
            blocks[-1][3] = last
    knots = [u[int(k)] for a, b, i, j in blocks for k in (i, j)]
    values = [a / b for a, b, i, j in blocks for _ in (i, j)]
    return np.array(knots), np.array(values)


class Scorer:
    def __init__(self, words: dict, starts: dict, model: Boosted | None, knots=None, values=None, prior: float = 0.0):
        self.words, self.starts, self.model, self.knots, self.values, self.prior = words, starts, model, knots, values, prior

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.model.raw(x), self.knots, self.values), 0.0, 1.0)


def _lexicon(counts, size: dict[tuple[int, int], int], half: int | None) -> dict[str, float]:
    """Lower bounds of log-odds from counts of documents by (half, label); ``half``: leave that half out."""
    use = [h for h in (0, 1) if h != half]
    n1, n0 = (sum(size.get((h, t), 0) for h in use) for t in (1, 0))
    found = {}
    for w, *c in counts:  # c: documents by (half, label) 00, 01, 10, 11
        c1, c0 = sum(c[2 * h + 1] for h in use), sum(c[2 * h] for h in use)
        low = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1)) - 1.64 * np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
        if c1 >= 3 and low >= MIN_WEIGHT:
            found[w] = float(low)
    return dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])


def sample_of(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, y, half, part of the labelled documents that may be learned from, ``rows`` of them at most."""
    y = labels.where("toxic IS NOT NULL AND crc32(cast(doc_id AS string)) % 3 <> 1").select("doc_id", F.col("toxic").cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    h = F.xxhash64(F.lit("fold"), F.col("doc_id"))
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("doc_id", "text", "y", F.pmod(h, F.lit(2)).cast("int").alias("half"), F.pmod(F.shiftright(h, 8), F.lit(4)).cast("int").alias("part"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Scorer:
    from landgrid.llm._util import materialise

    sample = materialise(sample_of(docs, labels, rows), "toxicity-sample")
    size = {(h, y): n for h, y, n in sample.groupBy("half", "y").count().collect()}
    total = sum(size.values())
    ones = sum(n for (_, y), n in size.items() if y == 1)
    if not 0 < ones < total:
        return Scorer({}, {}, None, prior=ones / total if total else 0.0)
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_@$*]+"), F.lit(0)))
    each = sample.select("half", "y", F.explode(words).alias("w"))
    begun = sample.select("half", "y", F.explode(F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > START), lambda w: F.substring(w, 1, START)))).alias("w"))
    n = lambda h, y: F.count_if((F.col("half") == h) & (F.col("y") == y))
    counts = []
    for rows_ in (each, begun):
        g = rows_.groupBy("w").agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1)).toDF("w", "a", "b", "c", "d").where("b + d >= 3")
        # among words of equal counts the choice is fixed by the word; more than these can't enter a lexicon
        counts.append(g.orderBy(((F.col("b") + F.col("d") + 0.5) / (F.col("a") + F.col("c") + 0.5)).desc(), "w").limit(4 * LEXICON).collect())
    lexicons = {half: [_lexicon(c, size, half) for c in counts] for half in (0, 1, None)}
    features = arrow_map(sample, lambda: _train_batch(lexicons), "y int, part int, x array<double>")
    got = features.collect()  # SAMPLE_ROWS rows of numbers at most
    x, y, part = np.array([r.x for r in got]), np.array([r.y for r in got], float), np.array([r.part for r in got])
    fitted, held = part != 0, part == 0
    if len(set(y[fitted])) < 2 or len(set(y[held])) < 2:
        fitted = held = np.ones(len(y), bool)
    model = Boosted(x[fitted], y[fitted])
    return Scorer(*lexicons[None], model, *isotonic(model.raw(x[held]), y[held]), prior=ones / total)


def _train_batch(lexicons):
    by = {h: Features(*lexicons[h]) for h in (0, 1)}

    def batch(rows: pa.RecordBatch) -> dict:
        x = [by[h].of(t.as_py()).tolist() for h, t in zip(rows.column("half").to_pylist(), rows.column("text"))]
        return {"y": rows.column("y"), "part": rows.column("part"), "x": x}

    return batch


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows with all their columns, and ``__toxicity``; scores read the text only."""
    shared, names = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns

    def make():
        s = shared.value
        f = Features(s.words, s.starts)

        def batch(rows: pa.RecordBatch) -> dict:
            return {c: rows.column(c) for c in names} | {"__toxicity": s(np.array([f.of(t.as_py()) for t in rows.column("text")]))}

        return batch

    return arrow_map(docs, make, StructType([*docs.schema, StructField("__toxicity", DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, scorer: Scorer | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = F.expr("crc32(cast(doc_id AS string)) % 3 = 1").alias("held_out")
    rows = scored(docs.select("doc_id", "text"), scorer or fit(docs, labels))
    return rows.select("doc_id", held, F.col("__toxicity").alias("score"), (F.col("__toxicity") >= threshold).cast("int").alias("predicted"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
