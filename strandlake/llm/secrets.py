"""Secret scan: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

DataFrame functions only. A null text counts as empty and has no spans; every row gives a row, repeated
ones too; other columns are ignored; an empty table gives an empty result. Positions are code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import stored, table, text_or_empty

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN_HEAD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = ASSIGN_HEAD + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"   # a run of 24 or more is matched from its start, so this equals dropping shorter runs
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the battery: whole runs of token characters of at least so many characters.
LEAST = 20
TOKEN = f"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
#: Encodings by the characters that occur: name, pattern of the whole token, alphabet size.
ENCODINGS = (
    ("hex", "[0-9a-f]+|[0-9A-F]+", 16),
    ("base32", "[A-Z2-7]+", 32),
    ("base36", "[0-9a-z]+|[0-9A-Z]+", 36),
    ("base64", "[A-Za-z0-9+/_-]+", 64),
)
LENGTH_STEPS = (28, 36, 48, 72, 128)   # limits of the length strata
GRADES = 40                             # steps of p in the discovery table
RATE = 0.05                             # accepted share of false discoveries in each stratum


def spans(text: Column, pattern: str) -> Column:
    """(start, end, match) of leftmost non-overlapping matches: what lies between them gives their places."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    place = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("match")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, place, step, lambda acc: acc["out"])


def kept(text: Column, pattern: str, size: Callable[[Column], Column], least: int) -> Column:
    """Spans of matches whose measured part is long enough; texts without a match are not taken apart."""
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(text.rlike(pattern), F.filter(spans(text, pattern), lambda x: size(x["match"]) >= least)).otherwise(empty)


def code_of(chars: Column, size: Column) -> Column:
    """Each character's place in its encoding's alphabet."""
    def place(c: Column) -> Column:
        a = F.ascii(c)
        digit, upper, lower = a - 48, a - 65, a - 97
        is_digit, is_upper = a.between(48, 57), a.between(65, 90)
        return (F.when(size == 16, F.when(is_digit, digit).when(is_upper, upper + 10).otherwise(lower + 10))
                .when(size == 32, F.when(is_digit, digit + 24).otherwise(upper))
                .when(size == 36, F.when(is_digit, digit).when(is_upper, upper + 10).otherwise(lower + 10))
                .otherwise(F.when(is_digit, digit + 52).when(is_upper, upper).when(a.between(97, 122), lower + 26)
                           .when(c.isin("+", "-"), F.lit(62)).otherwise(F.lit(63))))
    return F.transform(chars, place)


def tail(z: Column) -> Column:
    """Two-sided normal tail probability (a rational approximation, error below 2e-7)."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1 / (1 + 0.3275911 * x)
    return (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)


def battery(token: Column) -> Column:
    """struct(encoding, size, n, p): the token against a uniform draw from its inferred alphabet.

    Three statistics, each near a standard normal for random tokens: chi-squared of the symbol counts
    (by the cube-root approximation), runs above and below the middle of the alphabet, and the correlation
    of neighbours. p is the tail of the largest of the three, corrected for their number.
    """
    body = F.regexp_replace(token, "=+$", "")
    case = F.lit(None).cast("string")
    sizes = F.lit(None).cast("int")
    for name, pattern, size in reversed(ENCODINGS):
        whole = body.rlike(f"^(?:{pattern})$")
        case, sizes = F.when(whole, F.lit(name)).otherwise(case), F.when(whole, F.lit(size)).otherwise(sizes)
    chars = F.filter(F.split(body, ""), lambda c: c != "")

    def chi(x: Column) -> Column:
        m, n = x["size"].cast("double"), x["n"].cast("double")
        counts = F.transform(F.array_distinct(x["codes"]), lambda v: F.size(F.filter(x["codes"], lambda w: w == v)).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * c)
        free = m - 1
        stat = F.greatest(squares * m / n - n, F.lit(1e-9))
        return (F.cbrt(stat / free) - (1 - F.lit(2.0) / (9 * free))) / F.sqrt(F.lit(2.0) / (9 * free))

    def runs(x: Column) -> Column:
        n = x["n"].cast("double")
        half = F.transform(x["codes"], lambda v: (v * 2 >= x["size"]).cast("int"))
        up = F.aggregate(half, F.lit(0), lambda acc, v: acc + v).cast("double")
        turns = F.size(F.filter(F.sequence(F.lit(1), x["n"] - 1), lambda i: half[i] != half[i - 1])) + 1
        mean = 2 * up * (n - up) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(var > 0.25, (turns - mean) / F.sqrt(var)).otherwise(F.lit(6.0))

    def serial(x: Column) -> Column:
        n, mid = x["n"].cast("double"), (x["size"] - 1) / 2.0
        products = F.aggregate(F.sequence(F.lit(1), x["n"] - 1), F.lit(0.0), lambda acc, i: acc + (x["codes"][i] - mid) * (x["codes"][i - 1] - mid))
        var = (x["size"] * x["size"] - 1) / 12.0
        return products / (var * F.sqrt(n - 1))

    given = F.struct(case.alias("encoding"), sizes.alias("size"), F.size(chars).alias("n"), code_of(chars, sizes).alias("codes"))
    worst = lambda x: F.greatest(F.abs(chi(x)), F.abs(runs(x)), F.abs(serial(x)))
    return F.transform(F.array(given), lambda x: F.struct(x["encoding"].alias("encoding"), x["n"].alias("n"),
                                                          F.least(F.lit(1.0), 3 * tail(worst(x))).alias("p")))[0]


def stratum(n: Column) -> Column:
    out = F.lit(len(LENGTH_STEPS))
    for i, limit in reversed(list(enumerate(LENGTH_STEPS))):
        out = F.when(n <= limit, F.lit(i)).otherwise(out)
    return out


def candidates(text: Column, base: Column) -> Column:
    """Spans outside the base ones that mix letters and digits, with their test results."""
    empty = F.array().cast("array<struct<start:int,end:int,encoding:string,stratum:int,p:double>>")
    runs = F.filter(spans(text, TOKEN), lambda x: x["match"].rlike("[A-Za-z]") & x["match"].rlike("[0-9]"))
    free = F.filter(runs, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))

    def tested(x: Column) -> Column:
        return F.transform(F.array(battery(x["match"])), lambda t: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), t["encoding"].alias("encoding"), stratum(t["n"]).alias("stratum"), t["p"].alias("p")))[0]

    return F.when(text.rlike(TOKEN), F.filter(F.transform(free, tested), lambda x: x["encoding"].isNotNull())).otherwise(empty)


def limits(scanned: DataFrame, rate: float = RATE) -> dict[tuple[str, int], float]:
    """The least p that is accepted in each stratum (encoding, length): at most 24 of them.

    p is uniform for random tokens and small for others. Twice the tokens above one half estimates the
    random ones; what a limit accepts beyond their part is false. Shorter tokens give the tests less power,
    so each length has its own limit. Counts over all documents; one row a stratum and grade is returned.
    """
    grades = scanned.select(F.explode("found").alias("x")).groupBy("x.encoding", "x.stratum", F.least(
        F.lit(GRADES - 1), F.floor(F.col("x.p") * GRADES)).cast("int").alias("grade")).agg(F.count(F.lit(1)).alias("n"))
    counts: dict[tuple[str, int], list[int]] = {}
    for r in grades.collect():
        counts.setdefault((r["encoding"], r["stratum"]), [0] * GRADES)[r["grade"]] = r["n"]
    out = {}
    for key, n in counts.items():
        random = 2 * sum(n[GRADES // 2:])
        accepted, least = 0, None
        for g in range(GRADES - 1, -1, -1):
            accepted += n[g]
            false = accepted - random * (GRADES - g) / GRADES
            if accepted and false <= rate * accepted:
                least = g / GRADES
        if least is not None:
            out[key] = max(least, 1 / GRADES)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans of each kind, and found: accepted spans of the battery. Texts are read once and never shuffled."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("assign", kept(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)), 6))
    rows = rows.withColumn("access", kept(text, ACCESS, F.length, 20)).withColumn("hex", kept(text, HEX, F.length, 24))
    rows = rows.withColumn("found", candidates(text, F.concat("assign", "access", "hex")))
    place = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(c)
    scanned = stored(rows.select("doc_id", place("assign"), place("access"), place("hex"), "found"))
    accepted = F.lit(False)
    found = limits(scanned)

    def passes(x: Column) -> Column:
        ok = accepted
        for (encoding, length), least in found.items():
            ok = ok | ((x["encoding"] == encoding) & (x["stratum"] == length) & (x["p"] >= least))
        return ok

    return scanned.withColumn("random", F.transform(F.filter("found", passes), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))).drop("found")


def joined(columns: list[str]) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""
    def tag(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))

    tagged = [tag(c) for c in columns]
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.concat_ws(":", name[x["kind"]], x["start"], x["end"])), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = list(KINDS[:3])
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(list(KINDS)).alias("spans"), F.size("random").cast("long").alias("n_random"))
