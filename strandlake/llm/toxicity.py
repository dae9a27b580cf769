"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

A null text counts as empty and gets the score of no match. Rows with a null id, and repeated rows, are
scored like others. Labels with a null id or class are ignored. Other columns are ignored; an empty table
gives an empty result. Without usable labels the given terms keep their prior weight.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import stored, table, text_or_empty

SAMPLE = 12_000        # labelled documents, at most, that weights are learned from
LEXICON = 2_000        # terms, at most
EVIDENCE = 15.0        # log likelihood ratio a learned term needs: beyond what the best of some 100,000 candidates reaches by chance
LIFT = 2.0             # least log ratio of document shares of a learned term
PREFIX = (3, 7)        # lengths of learned word beginnings
PRIOR = 3.0            # weight of a given term before labels speak
CUT = 0.7

# Given terms, exception phrases and letters that look like Latin ones.
TERMS = ("idiot idiotic moron stupid loser scum trash pathetic disgusting worthless clown imbecile dumbass bastard asshole bitch "
         "retard degenerate vermin parasite filth subhuman").split()
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "taking out the trash", "clown fish", "circus clown", "class clown", "sore loser board",
              "idiot proof", "stupid question")
ALIKE = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "ι": "i", "κ": "k", "ν": "v", "υ": "u", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
    "\u200b": None, "\u200c": None, "\u200d": None, "\xad": None, "\ufeff": None})


def fold(text: str) -> str:
    """Lower case, compatibility forms and look-alike letters and digit substitutions as plain letters, without invisible characters.

    Accents stay: in most languages they tell words apart.
    """
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.translate(ALIKE)


def candidates(text: str) -> set[str]:
    """Words ("word ") and word beginnings ("begin") of a folded text."""
    out = set()
    for w in set(re.findall(r"[^\W\d_]+", fold(text))):
        out.add(w + " ")
        out.update(w[:k] for k in range(PREFIX[0], min(PREFIX[1], len(w) - 1) + 1))
    return out


class Matcher:
    """Weighted terms in one automaton; a term that ends in a space must be a whole word, others begin one."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.tree = ahocorasick.Automaton()
        for term, weight in weights.items():
            word = term.rstrip()
            had = self.tree.get(word, (len(word), 0.0, 0.0))
            self.tree.add_word(word, (len(word), had[1] + weight * (term == word), had[2] + weight * (term != word)))
        for phrase in EXCEPTIONS:
            self.tree.add_word(phrase, (len(phrase), None, None))
        self.tree.make_automaton()

    def total(self, text: str) -> tuple[float, int]:
        """Summed weight of matches outside exception phrases, and the number of words."""
        text = fold(text)
        hits, spared = [], []
        for end, (size, begin, whole) in self.tree.iter(text):
            start = end + 1 - size
            if start and text[start - 1].isalpha():
                continue
            if begin is None:
                spared.append((start, end))
            else:
                closed = end + 1 == len(text) or not text[end + 1].isalpha()
                if weight := begin + whole * closed:
                    hits.append((start, end, weight))
        if spared:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spared)]
        best: dict[int, float] = {}   # one weight a word: the largest of the terms that begin there
        for start, _, weight in hits:
            best[start] = max(best.get(start, weight), weight)
        return sum(best.values()), text.count(" ") + 1


def evidence(total: float, words: int) -> float:
    """Weight normalised by length: a match counts less the more words surround it."""
    return total / (1 + np.log1p(words / 200.0) / 4)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(text, toxic) of at most ``bound`` labelled documents that are not held out, each text once.

    Where the labels of an id, or of the rows with one text, disagree, the majority counts, and 0 in a tie.
    The ids are drawn by hash; being at most ``bound``, they may be broadcast, so that no text moves.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
    most = (F.avg("toxic") > 0.5).cast("int").alias("toxic")
    usable = usable.groupBy("doc_id").agg(most)
    drawn = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.join(F.broadcast(drawn), "doc_id").groupBy("text").agg(most)


def learn(sample: DataFrame) -> dict[str, float]:
    """Weights: smoothed log ratios of document shares. Given terms start from a prior; learned ones must show evidence.

    Document counts are summed in the tasks first; what reaches the driver is at most three times LEXICON terms.
    """
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    given = {t + " ": PRIOR for t in TERMS}
    if not n1 or not n0:
        return given

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(f["text"], f["toxic"], strict=True):
                seen[toxic].update(candidates(text))
            for term in seen[1]:
                seen[0][term] += 0
            yield pd.DataFrame({"term": list(seen[0]), "a": [seen[1].get(t, 0) for t in seen[0]], "b": list(seen[0].values())})

    sums = sample.mapInPandas(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    lift = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    known = F.col("term").isin(list(given))
    rows = sums.withColumn("lift", lift).withColumn("score", F.col("a") * F.col("lift"))
    rows = rows.filter(known | ((F.col("score") >= EVIDENCE) & (F.col("lift") >= LIFT)))
    rows = rows.orderBy(F.desc("score"), F.desc(F.length("term")), "term").limit(3 * LEXICON).collect()
    out = dict(given)
    for r in rows:
        if r["term"] in given:
            weight = (PRIOR + r["a"] * r["lift"]) / (1 + r["a"]) if r["a"] else PRIOR - np.log1p(r["b"])
            out[r["term"]] = float(max(weight, 0.0))
    counts = {r["term"]: r for r in rows}
    for r in rows:
        # the longest form that holds nearly all of its documents is the safest
        term = max((t for t in counts if t.startswith(r["term"]) and counts[t]["a"] >= 0.9 * r["a"]), key=lambda t: (len(t), t))
        covered = any(t.startswith(term.rstrip()) or term.startswith(t.rstrip()) for t in out)
        if not covered and len(out) < LEXICON + len(given):
            out[term] = float(counts[term]["lift"])
    return out


def calibrate(sample: DataFrame, weights: dict[str, float]) -> tuple[float, float]:
    """Slope and constant of a logistic curve of the evidence, fitted on the bounded sample by Newton steps with a weak prior."""
    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(weights)
        for f in frames:
            yield pd.DataFrame({"x": [float(evidence(*m.total(t))) for t in f["text"]], "y": f["toxic"].astype("int32")})

    got = sample.mapInPandas(measure, "x double, y int").toPandas()
    start = np.array([2.0, -2.5])
    if got["y"].nunique() < 2:
        return float(start[0]), float(start[1])
    x = np.column_stack([np.minimum(got["x"], 8.0), np.ones(len(got))])
    y, w = got["y"].to_numpy(dtype=float), start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (y - p) - (w - start))
        step *= min(1.0, 1.0 / np.abs(step).max())   # separable data make full steps overshoot
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


class Model:
    """What a task needs to score texts: bounded by LEXICON terms."""

    def __init__(self, weights: dict[str, float], slope: float, constant: float) -> None:
        self.weights, self.slope, self.constant = weights, slope, constant

    def scorer(self):
        m = Matcher(self.weights)

        def score(text: str) -> float:
            total, words = m.total(text)
            return float(1 / (1 + np.exp(-np.clip(self.slope * min(evidence(total, words), 8.0) + self.constant, -30, 30))))

        return score


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    sample = stored(training_rows(docs, labels, bound))
    weights = learn(sample)
    return Model(weights, *calibrate(sample, weights))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and _score; a column of docs named _score is replaced. Nothing is shuffled."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return docs.withColumn("_score", score(text_or_empty()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("_score").alias("score"),
                        (F.col("_score") >= CUT).cast("int").alias("predicted"))
