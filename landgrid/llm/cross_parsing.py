"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled running text gives the longest match of what follows at any place. A
document is parsed greedily into such matches by each automaton. Phrases are normalised: one costs log2 of the length of the
language's text over the number of places where the phrase stands (the bits that name one of them), and the language
with the fewest bits wins. Texts are read as lower-case letters with one blank for all else between them; phrases run
across words, and in the labelled text not across documents.

Fit: labelled documents of at most a quarter of ``SAMPLE_CHARS`` characters, in the order of a hash of doc_id, whole, at
most ``SAMPLE_DOCS`` of them a language and as long as they have ``SAMPLE_CHARS`` characters together. Only these
bounded texts come to the driver; from there they go to a file in the shared folder that executors build the automata from.
The rest of the operator covers every document whole. Prediction is a Java function (``java/CrossParse.java``);
``SuffixAutomaton`` and ``Model`` are the same for one text, without Spark, and tests hold both together.

Defined results: ``und`` with score 0 for null texts, texts without a letter (numbers are none) and where nothing could be learned; ties go
to the first language in alphabetical order; the score is second/(best + second) in bits, 1 if one language was learned;
repeated rows each have a row (and count each in the bounds of the fit); an empty table gives an empty result; columns
are kept as they are, whatever their names but ``__lang_pred`` and ``__lang_score``, which fail.
"""

from __future__ import annotations

import json
import math
import unicodedata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.functions import jvm
from landgrid.llm._util import scratch, table

SAMPLE_DOCS, SAMPLE_CHARS = 300, 1_000_000
APART = "\0"  # between documents of labelled text


def normal(text: str) -> str:
    out = [" "]
    for c in text:
        kind = unicodedata.category(c)[0]
        if kind == "L":
            out.append(c.lower()[0])
        elif kind == "M" and out[-1] not in (" ", APART):
            out.append(c)
        else:
            if out[-1] != " ":
                out.append(" ")
            out += [APART, " "] * (c == APART)
    return "".join(out if out[-1] == " " else [*out, " "])


class SuffixAutomaton:
    """Of a text; ``step`` maps (state, character) to the next state."""

    def __init__(self, text: str):
        link, longest, out = [-1], [0], [{}]
        last, clones = 0, {0}
        for ch in text:
            cur = len(out)
            out.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in out[p]:
                out[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = out[p][ch]
                if longest[q] == longest[p] + 1:
                    link[cur] = q
                else:
                    clone = len(out)
                    clones.add(clone)
                    out.append(dict(out[q]))
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    while p >= 0 and out[p].get(ch) == q:
                        out[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.size, self.out = len(text), out
        self.places = [int(i not in clones) for i in range(len(out))]
        for i in sorted(range(1, len(out)), key=lambda i: -longest[i]):
            self.places[link[i]] += self.places[i]

    def parse(self, words: str) -> list[int]:
        """Number of places of the longest matches that follow one another through `` words ``; 0: a character never seen."""
        state, found = 0, []
        for ch in f" {words} ":
            to = self.out[state].get(ch)
            if to is None:
                if state:
                    found.append(self.places[state])
                to = self.out[0].get(ch)
                if to is None:
                    found.append(0)
                    to = 0
            state = to
        return [*found, self.places[state]] if state else found

    def phrases(self, words: str) -> int:
        return len(self.parse(words))

    def bits(self, words: str) -> float:
        return sum(math.log2(max(2, self.size)) - math.log2(max(1, n)) for n in self.parse(words))


class Model:
    """The automata of all languages."""

    def __init__(self, texts: dict[str, str]):
        texts = {k: n for k, v in sorted(texts.items()) if len(n := normal(v)) > 2}
        self.langs, self.automata = list(texts), [SuffixAutomaton(t) for t in texts.values()]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = normal((text or "").replace(APART, " ")).strip()
        if not words or not self.langs:
            return "und", 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        cost = [a.bits(words) for a in self.automata]
        (best, lang), (second, _) = sorted(zip(cost, self.langs))[:2]
        return lang, second / (best + second)


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled documents that are not held out: crc32 of doc_id as text, modulo 5, is not 0."""
    return docs.where("lang IS NOT NULL AND text IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 <> 0")


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Language -> its labelled documents; bounded whatever the corpus."""
    rows = docs.select("lang", "doc_id", "text").withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    ids = training_rows(rows).withColumn("n", F.length("text") + 1).where(F.col("n") <= sample_chars // 4).select("lang", "doc_id", "h", "n")
    ids = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_docs)
    ids = ids.withColumn("sum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= sample_chars)
    # at most sample_docs ids a language: small enough to look the texts up by broadcast; copies of a row come once
    chosen = F.broadcast(ids.select("lang", "doc_id", "h").distinct())
    found: dict[str, list[str]] = {}
    for lang, _, _, text in sorted(rows.join(chosen, ["lang", "doc_id", "h"]).dropDuplicates(["lang", "doc_id", "h"]).select("lang", "doc_id", "h", "text").collect()):
        found.setdefault(lang, []).append(text.replace(APART, " "))
    return {lang: APART.join(texts) for lang, texts in found.items()}


def stored(spark: SparkSession, texts: dict[str, str]) -> str:
    """Path of the labelled texts as one file in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "languages") + ".json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(json.dumps(texts).encode()))
    finally:
        out.close()
    return path.toString()


def tagged(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """The rows with all their columns, and ``__lang_pred`` and ``__lang_score``; predictions read the text only."""
    if clash := {"__lang_pred", "__lang_score"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    spark = docs.sparkSession
    jvm.register(spark, Path(__file__).parent / "java" / "CrossParse.java", {"lg_language": ("landgrid.llm.CrossParse$Predict", "struct<__lang_pred: string, __lang_score: double>")})
    found = F.call_function("lg_language", F.col("text"), F.lit(stored(spark, fit(docs) if texts is None else texts)))
    # inline, so that the function runs once a row
    return docs.select("*", F.inline(F.array(found)))


def identify(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    texts = fit(docs) if texts is None else texts
    held = F.expr("crc32(cast(doc_id AS string)) % 5 = 0").alias("held_out")
    return tagged(docs.select("doc_id", "text"), texts).select("doc_id", held, F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
