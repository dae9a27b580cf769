"""Source divergence audit: how far the word use of a language's sources lies apart, and which terms stand out.

The terms that enough documents of a language hold are sorted and cut into shards; each shard becomes a minimal
acyclic transducer to lexicographic ordinals. All texts then stream through the transducers: they are recounted by
ordinal, scored in blocks of ordinals, and ties go to the smaller ordinal. Terms come back from ordinals by the same transducers.

Terms are runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased. A null text, language or source is ''.
Every occurring (language, source) group takes part, also without terms; a language without kept terms gives pairs of
value 0. Repeated rows count as often as they occur. All arithmetic is in whole numbers. Other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import stored, table, text_or_empty
from strandlake.llm.transducer import Transducer
from strandlake.operators.ranks import global_rank

LEAST = 3              # documents of a language that hold a kept term
UNIT = 1_000_000_000   # shares are whole billionths
TOP = 200              # terms a group lists
SHARD_BITS = 16        # a transducer holds at most 2 ** SHARD_BITS terms
BLOCK = 4096           # consecutive ordinals that are counted and scored together; places in a block take two bytes
CELLS = 1 << 21        # cells (term, source) that a task scores at a time
TILE = 256             # sources that one task compares with all others
BROADCAST = 32 << 20   # bytes of transducers that are broadcast; beyond, counted terms travel to their transducer
HELD = 1 << 18         # distinct terms that a task gathers before it hands them on
PLACES = 1 << 40       # ordinals of a language

# Bytes that are part of a term, A-Z as a-z; all others become spaces.
TERM_BYTES = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def grouped(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).cast("binary").alias("text"))


def batch_of(shape: dict[str, pa.DataType], rows: Iterable[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(shape)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, shape.values(), strict=True)], names=list(shape))


class Numbers(dict):
    """Terms by the order in which they are first met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def by_lang(batch: pa.RecordBatch) -> dict[str, list[int]]:
    rows = defaultdict(list)
    for i, lang in enumerate(batch.column(0).to_pylist()):
        rows[lang].append(i)
    return rows


def kept_terms(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term) of the terms that at least so many documents of the language hold."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[Numbers, np.ndarray]] = {}

        def handed(lang: str) -> pa.RecordBatch:
            terms, n = found.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(list(terms), pa.binary()), pa.array(n)], names=["lang", "term", "n"])

        for batch in batches:
            texts = batch.column(1)
            for lang, here in by_lang(batch).items():
                terms, n = found.get(lang, (Numbers(), np.zeros(0, np.int64)))
                words = [terms_of(texts[i].as_py()) for i in here]
                sizes = np.array([len(w) for w in words])
                ids = np.fromiter(map(terms.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
                once = np.unique(np.repeat(np.arange(len(here)), sizes) << 40 | ids) & (1 << 40) - 1
                now = np.bincount(once, minlength=len(terms))
                now[:len(n)] += n
                found[lang] = (terms, now)
                if len(terms) > HELD:
                    yield handed(lang)
        for lang in list(found):
            yield handed(lang)

    held = rows.select("lang", "text").mapInArrow(count, "lang string, term binary, n long")
    return held.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def sorted_shards(terms: DataFrame, bits: int = SHARD_BITS) -> DataFrame:
    """(lang, first, size, transducer, shard): at most 2 ** bits consecutive terms of a language; shard numbers follow (lang, first)."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = {"lang": pa.string(), "first": pa.binary(), "size": pa.int64(), "transducer": pa.binary()}
        lang, held = None, []
        done = lambda: batch_of(shape, [(lang, held[0], len(held), Transducer.build(held).dump())])
        for batch in batches:
            for here, term in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (here != lang or len(held) == 1 << bits):
                    yield done()
                    held = []
                lang = here
                held.append(term)
        if held:
            yield done()

    dealt = terms.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    built = dealt.mapInArrow(build, "lang string, first binary, size long, transducer binary")
    numbered = global_rank(built, [F.col("lang"), F.col("first")], "shard")
    before = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)   # one row for 2 ** bits terms
    return stored(numbered.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))))


class Shards:
    """Where the terms of each language lie: first term, number and first ordinal of every shard, in order."""

    def __init__(self, rows: list):
        self.firsts: dict[str, list[bytes]] = defaultdict(list)
        self.shards: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.offsets: dict[str, list[int]] = defaultdict(list)
        for r in sorted(rows, key=lambda r: r["shard"]):
            self.firsts[r["lang"]].append(bytes(r["first"]))
            self.shards[r["lang"]].append((r["shard"], r["offset"]))
            self.offsets[r["lang"]].append(r["offset"])

    def split(self, lang: str, terms: list[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
        """(shard, its first ordinal, terms) of sorted terms; what lies before the first shard is in none."""
        firsts = self.firsts.get(lang, [])
        cuts = [bisect_left(terms, first) for first in firsts] + [len(terms)]
        for (number, offset), begin, end in zip(self.shards.get(lang, []), cuts, cuts[1:], strict=False):
            if end > begin:
                yield number, offset, terms[begin:end]


class Places(dict):
    """Ordinals of a language's terms, -1 for those that are not kept. New terms run through the transducers together."""

    def __init__(self, lang: str, where: Shards, machines: dict[int, Transducer]):
        super().__init__()
        self.lang, self.where, self.machines = lang, where, machines

    def learn(self, terms: set[bytes]) -> None:
        new = sorted(terms.difference(self))
        self.update(dict.fromkeys(new, -1))
        for shard, offset, part in self.where.split(self.lang, new):
            local = self.machines[shard].ordinals(part)
            self.update(zip(part, np.where(local >= 0, offset + local, -1).tolist(), strict=True))


PIECE = "lang string, source string, block long, places binary, counts binary"


def piece_batches(lang: str, sources: list[str], keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted keys (number of the source * PLACES + ordinal) as one row for each source and block."""
    part = keys // BLOCK
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])[:len(part)])
    ends = np.append(begins, len(keys))[1:]
    place, n = (keys % BLOCK).astype("<u2"), counts.astype("<i8")
    head = keys[begins]
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * len(begins), pa.string()), pa.array([sources[i] for i in (head // PLACES).tolist()], pa.string()), pa.array(head % PLACES // BLOCK),
        pa.array([place[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
        pa.array([n[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())], names=["lang", "source", "block", "places", "counts"])


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    begins = np.flatnonzero(np.append(True, k[1:] != k[:-1])[:len(k)])
    return k[begins], np.add.reduceat(c, begins) if len(k) else c


def streamed(rows: DataFrame, shards: DataFrame, where: Broadcast) -> DataFrame:
    """Texts through broadcast transducers, where the texts are read."""
    machines = rows.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["transducer"]) for r in shards.select("shard", "transducer").collect()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {k: Transducer.load(v) for k, v in machines.value.items()}
        known: dict[str, Places] = {}
        held: dict[str, tuple[Numbers, list, list]] = {}
        for batch in batches:
            texts, names = batch.column(2), batch.column(1).to_pylist()
            for lang, here in by_lang(batch).items():
                words = [terms_of(texts[i].as_py()) for i in here]
                if len(known.get(lang, ())) > 4 * HELD:
                    del known[lang]
                places = known.setdefault(lang, Places(lang, where.value, loaded))
                places.learn(set(chain.from_iterable(words)))
                sizes = np.array([len(w) for w in words])
                at = np.fromiter(map(places.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
                sources, keys, counts = held.setdefault(lang, (Numbers(), [], []))
                key = np.repeat(np.array([sources[names[i]] for i in here]), sizes) * PLACES + at
                key, n = np.unique(key[at >= 0], return_counts=True)
                keys.append(key)
                counts.append(n)
                if sum(map(len, keys)) > 16 * HELD:
                    key, n = summed(keys, counts)
                    if len(key) > 8 * HELD:
                        yield piece_batches(lang, list(sources), key, n)
                        del held[lang]
                    else:
                        held[lang] = (sources, [key], [n])
        for lang, (sources, keys, counts) in held.items():
            yield piece_batches(lang, list(sources), *summed(keys, counts))

    return rows.mapInArrow(count, PIECE)


def routed(rows: DataFrame, shards: DataFrame, where: Broadcast) -> DataFrame:
    """Counted terms of the texts to the task of their shard's transducer."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = {"lang": pa.string(), "source": pa.string(), "shard": pa.int64(), "term": pa.binary(), "n": pa.int64()}
        for batch in batches:
            found: dict[tuple[str, str], Counter] = defaultdict(Counter)
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found[lang, source].update(terms_of(text.as_py()))
            for (lang, source), terms in found.items():
                yield batch_of(shape, ((lang, source, shard, t, terms[t]) for shard, _, part in where.value.split(lang, sorted(terms)) for t in part))

    def place(counts: pa.Table, machine: pa.Table) -> pa.Table:
        terms = counts.column("term").to_pylist()
        sources = Numbers()
        source = np.array([sources[s] for s in counts.column("source").to_pylist()], dtype=np.int64)
        local = Transducer.load(machine.column("transducer")[0].as_py()).ordinals(terms) if terms else np.zeros(0, np.int64)
        keys = source * PLACES + local + (machine.column("offset")[0].as_py() if terms else 0)
        keys, n = summed([keys[local >= 0]], [counts.column("n").to_numpy()[local >= 0]])
        return pa.Table.from_batches([piece_batches(machine.column("lang")[0].as_py(), list(sources), keys, n)])

    dealt = rows.mapInArrow(deal, "lang string, source string, shard long, term binary, n long")
    dealt = dealt.groupBy("lang", "source", "shard", "term").agg(F.sum("n").alias("n"))   # then 2 ** SHARD_BITS terms a source at most
    return dealt.groupBy("shard").cogroup(shards.select("shard", "lang", "offset", "transducer").groupBy("shard")).applyInArrow(place, PIECE)


def recounted(rows: DataFrame, shards: DataFrame, where: Broadcast, limit: int = BROADCAST) -> DataFrame:
    """(lang, source, block, places, counts, n): occurrences of the kept terms of a block of ordinals, and their sum.

    Transducers of at most ``limit`` bytes together are broadcast; beyond that the counted terms are dealt to them. Either way
    the pieces of a (source, block) meet sorted and are added up one after the other, so memory is that of one block.
    """
    total = shards.agg(F.sum(F.length("transducer"))).first()[0] or 0
    pieces = streamed(rows, shards, where) if total <= limit else routed(rows, shards, where)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "block", "places", "counts", "n"]
        now, sums = None, np.zeros(BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(sums)
            values = (*now, at.astype("<u2").tobytes(), sums[at].astype("<i8").tobytes(), int(sums.sum()))
            types = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            for *key, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if now is not None:
                        yield done()
                    now = key
                    sums[:] = 0
                sums[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<i8")
        if now is not None:
            yield done()

    met = pieces.repartition("lang", "source", "block").sortWithinPartitions("lang", "source", "block")
    return met.mapInArrow(add, PIECE + ", n long")


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exact beyond 64-bit products: the factor is applied in two parts."""
    first, second = 32_000, UNIT // 32_000
    whole, rest = np.divmod(count + 1, total)
    part, rest = np.divmod(rest * first, total)
    return 1 + UNIT * whole + second * part + rest * second // total


def score_block(rows: pa.Table, tile_size: int, cells: int) -> pa.Table:
    """A block of terms of one language: sums for the tile's sources against all sources, and the best terms of each."""
    lang, block, tile = (rows.column(c)[0].as_py() for c in ("lang", "block", "tile"))
    heads = rows.filter(pa.compute.is_null(rows.column("places")))
    idx = heads.column("idx").to_numpy()
    total = np.zeros(len(idx), dtype=np.int64)
    total[idx] = heads.column("n").to_numpy()
    v = heads.column("kept")[0].as_py()
    held = rows.filter(pa.compute.is_valid(rows.column("places")))
    entries = [(i, np.frombuffer(p, "<u2"), np.frombuffer(c, "<i8")) for i, p, c in zip(*(held.column(c).to_pylist() for c in ("idx", "places", "counts")), strict=True)]
    mine = np.arange(tile * tile_size, min(len(total), (tile + 1) * tile_size))
    sums = np.zeros((len(mine), len(total)), dtype=np.int64)
    best: list[list[tuple[int, int]]] = [[] for _ in mine]   # of each source: (-value, ordinal)
    size, width = min(BLOCK, v - block * BLOCK), max(1, cells // len(total))
    for begin in range(0, size if v else 0, width):
        counts = np.zeros((len(total), min(width, size - begin)), dtype=np.int64)
        for i, places, n in entries:
            a, b = np.searchsorted(places, (begin, begin + counts.shape[1]))
            np.add.at(counts[i], places[a:b] - begin, n[a:b])
        p = shares(counts, (total + v)[:, None])
        q = shares(counts.sum(axis=0), int(total.sum()) + v)
        for k, a in enumerate(mine.tolist()):
            sums[k] += ((p - p[a]) ** 2 // p).sum(axis=1)
            stands = np.flatnonzero((counts[a] > 0) & (p[a] > q))
            f = (p[a][stands] - q[stands]) ** 2 // q[stands]
            top = np.lexsort((stands, -f))[:TOP]
            best[k] = sorted(best[k] + list(zip((-f[top]).tolist(), (block * BLOCK + begin + stands[top]).tolist(), strict=True)))[:TOP]
    out = [(lang, a, b, None, int(sums[k, b])) for k, a in enumerate(mine.tolist()) for b in range(len(total)) if b != a]
    out += [(lang, a, None, ordinal, -f) for k, a in enumerate(mine.tolist()) for f, ordinal in best[k]]
    shape = {"lang": pa.string(), "idx": pa.int32(), "other": pa.int32(), "ordinal": pa.int64(), "value": pa.int64()}
    return pa.Table.from_batches([batch_of(shape, out)])


def scored(heads: DataFrame, counts: DataFrame, tile: int = TILE, cells: int = CELLS) -> DataFrame:
    """(lang, idx, other, ordinal, value): parts of the pair sums and candidates of the term lists.

    A task holds a block of terms and scores so many cells at a time, whatever the number of sources, so none grows with a language or a source.
    """
    tiles = F.explode(F.expr(f"sequence(0, cast((sources - 1) div {tile} as int))")).alias("tile")
    met = counts.join(heads.select("lang", "source", "idx", "sources"), ["lang", "source"]).select(
        "lang", "block", tiles, "idx", "places", "counts", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("kept"))
    blocks = heads.withColumn("block", F.explode(F.expr(f"sequence(0L, greatest(kept - 1, 0L) div {BLOCK})")))
    none = F.lit(None).cast("binary")
    frames = blocks.select("lang", "block", tiles, "idx", none.alias("places"), none.alias("counts"), F.col("total").alias("n"), "kept")
    return met.union(frames).groupBy("lang", "block", "tile").applyInArrow(
        lambda rows: score_block(rows, tile, cells), "lang string, idx int, other int, ordinal long, value long")


def named_terms(listed: DataFrame, shards: DataFrame, where: Broadcast) -> DataFrame:
    """The rows with the term of their ordinal as item, read back from its transducer."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [where.value.shards[lang][bisect_right(where.value.offsets[lang], o) - 1] for lang, o in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [*batch.columns, pa.array([s for s, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "idx", "ordinal", "value", "rank", "shard", "offset"])

    def name(rows: pa.Table, machine: pa.Table) -> pa.Table:
        local = [o - f for o, f in zip(rows.column("ordinal").to_pylist(), rows.column("offset").to_pylist(), strict=True)]
        held = Transducer.load(machine.column("transducer")[0].as_py()) if local else None
        known = {o: held.term(o) for o in set(local)}
        return rows.select(["lang", "idx", "value", "rank"]).append_column("item", pa.array([known[o] for o in local], pa.binary()))

    rows = listed.select("lang", "idx", "ordinal", "value", "rank").mapInArrow(find, "lang string, idx int, ordinal long, value long, rank int, shard long, offset long")
    both = rows.groupBy("shard").cogroup(shards.select("shard", "transducer").groupBy("shard"))
    return both.applyInArrow(name, "lang string, idx int, value long, rank int, item binary")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP,
                      bits: int = SHARD_BITS, limit: int = BROADCAST, tile: int = TILE, cells: int = CELLS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank; ``top`` is at most TOP."""
    rows = grouped(docs, text_col, lang_col, source_col)
    shards = sorted_shards(kept_terms(rows, least), bits)
    where = rows.sparkSession.sparkContext.broadcast(Shards(shards.select("lang", "first", "shard", "offset").collect()))   # one line for 2 ** bits terms
    counts = stored(recounted(rows, shards, where, limit))
    kept = shards.groupBy("lang").agg(F.sum("size").alias("kept"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = Window.partitionBy("lang")
    heads = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept"])
    heads = stored(heads.withColumn("idx", F.row_number().over(of_lang.orderBy("source")) - 1).withColumn("sources", F.count(F.lit(1)).over(of_lang)))
    found = stored(scored(heads, counts.drop("n"), tile, cells))
    group = Window.partitionBy("lang", "idx")
    listed = found.filter("other is null").withColumn("rank", F.row_number().over(group.orderBy(F.col("value").desc(), "ordinal"))).filter(F.col("rank") <= top)
    terms = named_terms(listed, shards, where)
    names = heads.select("lang", "idx", "source")
    pairs = found.filter("other is not null").groupBy("lang", "idx", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.join(names.select("lang", F.col("idx").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pairs = pairs.withColumn("rank", F.row_number().over(group.orderBy(F.col("value").desc(), "item"))).select("lang", "idx", "value", "rank", "item")
    both = pairs.withColumn("part", F.lit("pair")).union(terms.withColumn("item", F.col("item").cast("string")).withColumn("part", F.lit("term")))
    return both.join(names, ["lang", "idx"]).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS terms
  FROM documents
), t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS total FROM groups g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + v.v) AS p
  FROM totals g JOIN vocab v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
whole AS (
  SELECT l.lang, l.term, 1 + (1000000000 * (l.n + 1)) // (x.total + v.v) AS q
  FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL) l JOIN (SELECT lang, sum(total)::BIGINT AS total FROM totals GROUP BY ALL) x USING (lang)
  JOIN vocab v USING (lang)
),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
term AS (
  SELECT a.lang, a.source, a.term AS item, (a.p - w.q) * (a.p - w.q) // w.q AS value
  FROM cells a JOIN whole w ON a.lang = w.lang AND a.term = w.term WHERE a.n > 0 AND a.p > w.q
),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term
), numbered AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM numbered WHERE part = 'pair' OR rank <= 200
"""
