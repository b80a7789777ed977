"""SentencePiece encoding, decoding and sampled segmentations without replacement (Gumbel top-k).

Sampling works on the lattice of all ways to write the normalised text in pieces of the model. A piece weighs alpha times
its log-probability: the model's score for unigram models, Zipf's law of the merge rank for BPE models. No piece holds a
word-start mark after another character, so the lattice is a chain of word lattices; each gets its conditional edge
probabilities once from a backward pass.

Search: the set of all segmentations has a Gumbel value; its best member is a plain sample with that value. What remains
are the sets that share a prefix of the sample and leave it at one node; each gets a Gumbel value of its own mass,
truncated at the sample's. These values are exact upper bounds, so the search that always opens the set with the highest
value (A* with a perfect heuristic) emits distinct segmentations in the order of their perturbed log-probabilities,
which is sampling without replacement. The value of the best set left over after k samples is the threshold of the
inclusion score: P(included) = 1 - exp(-exp(log p - threshold)).

All random numbers are hashes of (row key, draw, place): a row gives the same samples on any executor and retry.

Tables are searched, encoded and decoded by the Java functions of ``java/Segments.java``, inside the JVM; a thread keeps the lattices of
words up to a bound of edges. ``Lattices``, ``sample``, ``encode`` and ``decode`` are the same for one text, without Spark; tests hold both
together and both encodings against the library's. The model is read where its path says, on each executor.

Defined results: null and empty texts have one segmentation, the empty one, with log-probability 0; fewer than k samples
come back where the lattice has fewer; a null doc_id is key 0; repeated rows give equal samples; a text is one row's work however long
it is; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.functions import jvm
from landgrid.llm._util import table
from landgrid.llm.bpe_words import tokenizer_path

SAMPLES, ALPHA, MODEL = 2, 1.0, "piece_bpe_32k.model"
MARK = "▁"
_ROWS = "array<struct<rank: int, ids: array<int>, n_pieces: long, log_prob: double, log_inclusion: double, ids_crc32: long, round_trip: boolean>>"
_FUNCTIONS = {"lg_segments": ("landgrid.llm.Segments$Sample", _ROWS), "lg_pieces": ("landgrid.llm.Segments$Encode", "array<int>"), "lg_unpieced": ("landgrid.llm.Segments$Decode", "string")}


class Lattices:
    """A model's pieces and the lattices of single texts."""

    def __init__(self, folder: str | None = None, alpha: float = ALPHA, model: str = MODEL):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model, folder))
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = [sp.get_score(i) for i in normal]
        if all(s == round(s) for s in scores):  # merge ranks
            scores = [-math.log1p(-s) - math.log(math.log(n) + 0.57721566490153286) for s in scores]
        self.weight = {sp.id_to_piece(i): (i, alpha * w) for i, w in zip(normal, scores)}
        self.bytes = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.lowest = alpha * min(scores)
        self.longest = max(map(len, self.weight))
        self.pairs = {p[i : i + 2] for p in self.weight for i in range(len(p) - 1)}

    def normalise(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def nodes(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """By place of the normalised text: (next place, log of conditional probability, ids), likeliest first."""
        s = self.normalise(text)
        out: list[list] = []
        for i, c in enumerate(s):
            edges = [(i + d, w, (k,)) for d in range(1, min(self.longest, len(s) - i) + 1) for k, w in [self.weight.get(s[i : i + d], (-1, 0.0))] if k >= 0]
            if c not in self.weight:
                raw = c.encode()
                edges.append((i + 1, self.lowest * len(raw), tuple(self.bytes[b] for b in raw)))
            out.append(edges)
        beta = [0.0] * (len(s) + 1)
        for i in range(len(s) - 1, -1, -1):
            mass = [w + beta[j] for j, w, _ in out[i]]
            top = max(mass)
            beta[i] = top + math.log(sum(math.exp(m - top) for m in mass)) if len(mass) > 1 else top
            out[i] = sorted(((j, min(0.0, m - beta[i]), k) for (j, _, k), m in zip(out[i], mass)), key=lambda e: -e[1])
            if s[i - 1 : i + 1] not in self.pairs:
                beta[i] = 0.0  # all segmentations have a border here: the lattice behind it by itself
        return out


class _Draws:
    """Numbers in (0, 1) that hang on row key, draw and place; fixed values of splitmix64."""

    def __init__(self, key: int, draw: int):
        self.state = self._mixed(self._mixed(key) + draw)

    @staticmethod
    def _mixed(x: int) -> int:
        x &= 2**64 - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 2**64 - 1
        x = (x ^ x >> 27) * 0x94D049BB133111EB & 2**64 - 1
        return x ^ x >> 31

    def next(self) -> float:
        self.state = self.state + 0x9E3779B97F4A7C15 & 2**64 - 1
        return (self._mixed(self.state) >> 11) * 2.0**-53 + 2.0**-54


def _truncated(mass: float, top: float, u: float) -> float:
    """Gumbel value of a set of log-mass ``mass``, given that it is at most ``top``."""
    a, b = -top, math.log(-math.log(u)) - mass
    return min(top, -(max(a, b) + math.log(1 + math.exp(-abs(a - b)))))


class _Path:
    """One emitted segmentation: (place, edge number) of its edges, and the values of the sets that leave it there."""

    def __init__(self, nodes: list, prefix: list, at: int, value: float, draws: _Draws, since: int):
        self.steps, self.value, self.taken = list(prefix), value, {}
        while at < len(nodes):
            e, edges = 0, nodes[at]
            if len(edges) > 1:
                x, c = draws.next(), math.exp(edges[0][1])
                while e < len(edges) - 1 and x >= c:
                    e += 1
                    c += math.exp(edges[e][1])
            self.steps.append((at, e))
            at = edges[e][0]
        self.before, self.logp, self.values = [], 0.0, []
        for t, (i, e) in enumerate(self.steps):
            self.before.append(self.logp)
            others = sum(math.exp(x[1]) for k, x in enumerate(nodes[i]) if k != e)  # not taken from 1, as they may be few
            self.values.append(_truncated(self.logp + math.log(others), value, draws.next()) if t >= since and others > 0 else -math.inf)
            self.logp += nodes[i][e][1]


def sample(lat: Lattices, text: str, key: int, k: int = SAMPLES) -> list[dict]:
    """Up to k distinct segmentations: ids, log_prob, value (perturbed), log_inclusion; highest value first."""
    nodes, draws = lat.nodes(text), _Draws(key, 0)
    paths = [_Path(nodes, [], 0, -math.log(-math.log(draws.next())), draws, 0)]
    best = lambda: max(((max(p.values, default=-math.inf), -n) for n, p in enumerate(paths)))
    while len(paths) < k and best()[0] > -math.inf:
        top, n = best()
        p = paths[-n]
        t = p.values.index(top)
        at, own = p.steps[t]
        draws = _Draws(key, len(paths))
        taken = p.taken.setdefault(t, [own])
        free = [(e, math.exp(x[1])) for e, x in enumerate(nodes[at]) if e not in taken]
        x = draws.next() * sum(c for _, c in free)
        for e, c in free:
            x -= c
            if x < 0:
                break
        taken.append(e)
        left = sum(c for f, c in free if f != e)
        p.values[t] = _truncated(p.before[t] + math.log(left), top, draws.next()) if left > 0 else -math.inf
        paths.append(_Path(nodes, [*p.steps[:t], (at, e)], nodes[at][e][0], top, draws, t + 1))
    threshold, found = best()[0], []
    for p in paths:
        gap = p.logp - threshold
        score = 0.0 if threshold == -math.inf else gap if gap < -30 else math.log(-math.expm1(-math.exp(min(gap, 700.0))))
        found.append({"ids": [i for at, e in p.steps for i in nodes[at][e][2]], "log_prob": p.logp, "value": p.value, "log_inclusion": score})
    return found


def encode(lat: Lattices, text: str) -> list[int]:
    return lat.sp.encode(text)


def decode(lat: Lattices, ids: list[int]) -> str:
    return lat.sp.decode(ids)


def _call(spark: SparkSession, name: str, *args) -> F.Column:
    jvm.register(spark, Path(__file__).parent / "java" / "Segments.java", _FUNCTIONS)
    return F.call_function(name, *[a if isinstance(a, F.Column) else F.lit(a) for a in args])


def encoded(docs: DataFrame, folder: str | None = None, column: str = "text", to: str = "ids") -> DataFrame:
    """The rows with ``to``: the library's ids of the text; null for null."""
    return docs.withColumn(to, _call(docs.sparkSession, "lg_pieces", F.col(column), tokenizer_path(MODEL, folder)))


def decoded(rows: DataFrame, folder: str | None = None, column: str = "ids", to: str = "text") -> DataFrame:
    """The rows with ``to``: the text that the ids write; null for null. An id that the model does not have fails the job."""
    return rows.withColumn(to, _call(rows.sparkSession, "lg_unpieced", F.col(column), tokenizer_path(MODEL, folder)))


def sampled_segmentations(docs: DataFrame, k: int = SAMPLES, folder: str | None = None, with_encoding: bool = False, alpha: float = ALPHA) -> DataFrame:
    """doc_id, rank (from 1), ids, n_pieces, log_prob, log_inclusion, ids_crc32 (little-endian unsigned 32-bit).

    ``with_encoding``: also each row's deterministic encoding, as rank 0 without probabilities, and the column ``round_trip``:
    whether the ids decode to the whole text (where ``▁`` itself reads as a space, which the model can't tell apart).
    """
    rows = _call(docs.sparkSession, "lg_segments", F.col("text"), F.col("doc_id").cast("long"), tokenizer_path(MODEL, folder), k, float(alpha), with_encoding)
    out = docs.select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.*")
    return out if with_encoding else out.drop("round_trip")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_segmentations(table(spark, sf_dir, "documents"), with_encoding=True)
