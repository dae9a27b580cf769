"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier is trained.

A null text counts as empty; every row gives a row; other columns are ignored; an empty table gives an
empty result. Positions are code points. Base spans always stay; the classifier decides on the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import stored, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Runs are possessive and start where no run is under way, so a long run is read once.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]++(@?)")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser forms that only the classifier can accept.
LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{2,40}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]{2,40}(?:\s?[\[(]\s?dot\s?[\])]\s?[A-Za-z]{2,10})+")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9-])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9-])|(?<![0-9])[0-9]{14,16}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")),
)
# Gazetteers of endings and prefixes, and words that speak for a kind nearby.
ENDINGS = frozenset("com org net edu gov info io de fr es uk eu us ca au jp".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
CONTEXT = {
    "email": frozenset("email e-mail mail contact write kontakt correo courriel".split()),
    "ip": frozenset("ip host server address addr client from adresse".split()),
    "card": frozenset("card visa mastercard credit debit payment karte tarjeta carte".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon fon llame appelez".split()),
}
AGAINST = frozenset("order invoice version isbn page figure item ref id no number serial".split())
WINDOW = 48

SIGNS = ("base", "check", "gazetteer", "context", "shape")
FLOOR = 0.5


def luhn(digits: str) -> bool:
    twice = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in twice)) % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of runs before an @ with a domain after it. A domain may end inside a run; the rest of that run can go on."""
    pos = 0
    for run in LOCAL.finditer(text):
        start = max(run.start(), pos)
        if run[1] and start < run.start(1):
            domain = DOMAIN.match(text, run.end())
            if domain:
                pos = domain.end()
                yield start, pos


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted. A character that each pattern needs is looked for first."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if not re.search("[0-9]", text):
        return out
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """One character a labeler, in the order of SIGNS: + for, - against, 0 abstains."""
    span, d = text[start:end], digits_of(text[start:end])
    around = set(re.findall(r"[a-z-]+", text[max(0, start - WINDOW):start].lower() + " " + text[end:end + WINDOW].lower()))
    if kind == "email":
        last = re.split(r"[^A-Za-z]+", span.rstrip(")] "))[-1].lower()
        check, known, shape = "0", "+" if last in ENDINGS else "-", "+" if len(span) <= 80 else "-"
    elif kind == "ip":
        parts = span.split(".")
        check = "0" if ":" in span else "+" if all(p == (p.lstrip("0") or "0") for p in parts) else "-"
        known = "0" if ":" in span else "-" if parts[0] in ("0", "1", "2", "3") and len(span) < 9 else "+"
        shape = "-" if text[end:end + 1] == "." and text[end + 1:end + 2].isdigit() or text[start - 1:start] == "." else "+"
    elif kind == "card":
        check, known = "+" if luhn(d) else "-", "+" if d.startswith(ISSUERS) else "-"
        shape = "+" if len(d) in (15, 16) else "-"
    else:
        check, known = "+" if 10 <= len(d) <= 15 else "-", "-" if d[-10:-7] in ("000", "111", "999") else "0"
        shape = "+" if re.search(r"[() .-]", span) else "-"
    near = "+" if around & CONTEXT[kind] else "-" if around & AGAINST else "0"
    return ("+" if base else "-" if kind != "email" else "0") + check + known + near + shape


SCANNED = "doc_id long, base array<struct<start:int,kind:int,end:int,mark:string>>, loose array<struct<start:int,kind:int,end:int,mark:string>>"


def marked(text: str) -> tuple[list[dict], list[dict]]:
    base = base_spans(text)
    item = lambda s, k, e, b: {"start": s, "kind": k, "end": e, "mark": KINDS[k] + ":" + votes(text, KINDS[k], s, e, b)}
    loose: list[tuple[int, int, int]] = []
    if re.search(r"[0-9]|[\[(]\s?at", text):
        taken = bytearray(len(text))   # a mark for each character of a span
        for a, _, b in base:
            taken[a:b] = b"\1" * (b - a)
        for kind, pattern in LOOSE:
            for m in pattern.finditer(text):
                a, b = m.span()
                if taken.find(1, a, b) < 0:
                    taken[a:b] = b"\1" * (b - a)
                    loose.append((a, KINDS.index(kind), b))
    return [item(*x, True) for x in base], [item(*x, False) for x in sorted(loose)]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, loose) of every row; mark is the kind and the votes of a span. Nothing is shuffled."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [marked(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "base": [x[0] for x in found], "loose": [x[1] for x in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(batches, SCANNED)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability of each vote pattern (-1, 0, 1 a labeler) to be personal data, by a two-class model of independent labelers.

    Starts from the majority vote; every class keeps a Dirichlet count of one for each vote, so that a
    labeler that never disagrees does not become certain.
    """
    p = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))
    for _ in range(rounds):
        logs = []
        for w in (p * counts, (1 - p) * counts):
            share = np.log((w.sum() + 1) / (counts.sum() + 2))
            each = np.stack([((patterns == v) * w[:, None]).sum(axis=0) + 1.0 for v in (-1, 0, 1)])
            logs.append(share + np.log(each / each.sum(axis=0))[patterns + 1, np.arange(patterns.shape[1])].sum(axis=1))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
        if np.abs(new - p).max() < 1e-6:
            return new
        p = new
    return p


def classifier(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression with a ridge of one by Newton steps on weighted distinct rows; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def features(mark: str) -> list[float]:
    kind, v = mark.split(":")
    signs = [{"-": -1.0, "0": 0.0, "+": 1.0}[c] for c in v]
    return [float(kind == k) for k in KINDS] + signs + [signs[1] * signs[4], signs[2] * signs[3]]


def accepted_marks(scanned: DataFrame, floor: float = FLOOR) -> set[str]:
    """The marks that the trained classifier accepts.

    All spans of all documents are counted by mark before anything reaches the driver: there are at most
    len(KINDS) * 3 ** len(SIGNS) = 972 marks.
    """
    marks = scanned.select(F.explode(F.concat("base", "loose")).alias("x")).groupBy(F.col("x.mark").alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    rows = marks.orderBy("mark").collect()
    if not rows:
        return set()
    names, counts = [r["mark"] for r in rows], np.array([r["n"] for r in rows], dtype=float)
    truth = np.zeros(len(names))
    for kind in KINDS:
        at = np.array([i for i, m in enumerate(names) if m.startswith(kind + ":")], dtype=int)
        if len(at):
            signs = np.array([[{"-": -1, "0": 0, "+": 1}[c] for c in names[i].split(":")[1]] for i in at])
            truth[at] = reliabilities(signs, counts[at])
    x = np.array([features(m) for m in names])
    w = classifier(x, truth, counts)
    p = 1 / (1 + np.exp(-(np.hstack([x, np.ones((len(x), 1))]) @ w)))
    return {m for m, q in zip(names, p, strict=True) if q >= floor}


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): added holds the loose spans that the classifier accepts."""
    scanned = stored(scan(docs))
    marks = sorted(accepted_marks(scanned))
    return scanned.select("doc_id", "base", F.filter("loose", lambda x: x["mark"].isin(marks)).alias("added"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")

    def counted(kind: int):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *[counted(k) for k in range(len(KINDS))], F.sha2(text(F.col("base")), 256).alias("base_sha256"),
                        text(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
