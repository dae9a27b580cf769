"""Greedy bridge selection and chains.

The rule is sequential: bridges in ascending order, one per fragment end, none that closes a cycle. Bridges of
different candidate components never meet, so components that fit one task are decided there, many in a task.
Larger ones take rounds over tables. Of the open bridges a round decides

* every one that no smaller open bridge contests at its two ends. A cycle of smaller bridges would have to go on at the free far
  ends of both paths it joins; where one of them has no smaller open bridge, it is accepted;
* every run of bridges each of which is contested by one smaller bridge only: its fate is a function of that one's,
  and the functions of a run are composed by pointer doubling.

So neither a rising row of bridges nor a rising row of conflicts costs a round a bridge. The result is the sequential one.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.components import edge_components
from strandlake.operators.ranks import global_rank
from strandlake.params import Params
from strandlake.session import materialize, release

SOLVED = 1 << 18   # candidates of a component that one task decides
NAMES = ["frag_a", "end_a", "frag_b", "end_b"]
DEAD, TAKEN, OPEN = 0, 1, 2


def _slot(frag, end):
    return F.when(end == 0, frag).otherwise(F.bitwise_not(frag)).cast("long")


def _slots(ends: DataFrame, cands: DataFrame, p: Params) -> DataFrame:
    """Candidates with the ends they need (slot) and the far ends of those fragments (mate)."""
    single = ends.select("frag", (F.col("head") == F.col("tail")).alias("one"))
    c = cands.filter((F.col("cost") <= p.max_commit_cost) & (F.col("frag_a") != F.col("frag_b"))).select(*NAMES, "cost", (-F.col("score")).alias("ns"))
    for s in "ab":
        c = c.join(single.select(F.col("frag").alias(f"frag_{s}"), F.col("one").alias(f"one_{s}")), f"frag_{s}")
        e = F.when(F.col(f"one_{s}"), 0).otherwise(F.col(f"end_{s}"))
        frag = F.col(f"frag_{s}")
        c = c.withColumn(f"slot_{s}", _slot(frag, e)).withColumn(f"mate_{s}", _slot(frag, 1 - e)).drop(f"one_{s}")
    return c


def _decided(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole components: the rule as it stands. A path knows its two free ends."""
    pdf = pdf.sort_values(["cost", "ns", *NAMES])
    far: dict[int, int] = {}   # free end of a path of several fragments: its other free end
    used, took = set(), []
    for i, (a, b, ma, mb) in enumerate(zip(*(pdf[c].tolist() for c in ("slot_a", "slot_b", "mate_a", "mate_b")))):
        if a in used or b in used:
            continue
        ma, mb = far.get(a, ma), far.get(b, mb)
        if ma == b:
            continue
        used |= {a, b}
        far[ma], far[mb] = mb, ma
        took.append(i)
    return pdf.iloc[took][NAMES]


def _fates(open_: DataFrame) -> DataFrame:
    """(k, fate) of every open bridge; k is its place in the order."""
    at = open_.select(F.explode(F.array("slot_a", "slot_b")).alias("slot"), "k")
    first = at.groupBy("slot").agg(F.min("k").alias("k1"))
    second = at.join(first, "slot").filter("k > k1").groupBy("slot").agg(F.min("k").alias("k2"))
    least = materialize(first.join(second, "slot", "left"))
    e = open_.select("k", "slot_a", "slot_b", "mate_a", "mate_b")
    for s in "ab":
        e = e.join(least.select(F.col("slot").alias(f"slot_{s}"), F.col("k1").alias(f"k1{s}"), F.col("k2").alias(f"k2{s}")), f"slot_{s}")
        e = e.join(least.select(F.col("slot").alias(f"mate_{s}"), F.col("k1").alias(f"m{s}")), f"mate_{s}", "left")
    safe = F.when(F.coalesce(F.col("ma") > F.col("k"), F.lit(True)) | F.coalesce(F.col("mb") > F.col("k"), F.lit(True)), TAKEN).otherwise(OPEN)
    rival = {s: F.when(F.col(f"k1{s}") < F.col("k"), F.col(f"k1{s}")) for s in "ab"}
    more = F.coalesce(F.col("k2a") < F.col("k"), F.lit(False)) | F.coalesce(F.col("k2b") < F.col("k"), F.lit(False)) | F.coalesce(rival["a"] != rival["b"], F.lit(False))
    ptr = F.when(~more, F.coalesce(rival["a"], rival["b"]))
    value = F.when(more, OPEN).when(ptr.isNull(), safe)
    now = materialize(e.select("k", ptr.alias("ptr"), F.lit(DEAD).alias("on_taken"), safe.alias("on_dead"), value.alias("fate")))
    release(least)
    apply = lambda x: F.when(x == TAKEN, F.col("on_taken")).when(x == DEAD, F.col("on_dead")).otherwise(OPEN)
    while not now.filter("fate is null").isEmpty():   # runs halve their length
        t = now.select(F.col("k").alias("ptr"), F.col("ptr").alias("next"), F.col("on_taken").alias("t1"), F.col("on_dead").alias("t0"), F.col("fate").alias("known"))
        todo = now.filter("fate is null").join(t, "ptr").select(
            "k", F.col("next").alias("ptr"), apply(F.col("t1")).alias("on_taken"), apply(F.col("t0")).alias("on_dead"),
            F.when(F.col("known").isNotNull(), apply(F.col("known"))).alias("fate"))
        past, now = now, materialize(now.filter("fate is not null").union(todo))
        release(past)
    return now.select("k", "fate")


def _in_rounds(cands: DataFrame, max_rounds: int) -> DataFrame:
    """The accepted ones of any number of connected candidates."""
    open_ = materialize(global_rank(cands, [F.col(c) for c in ("cost", "ns", *NAMES)], "k").select("k", *NAMES, "slot_a", "mate_a", "slot_b", "mate_b"))
    done = []
    while not open_.isEmpty():
        if len(done) == max_rounds:
            raise RuntimeError("bridge selection did not finish")
        fates = _fates(open_)
        fated = materialize(open_.join(fates, "k"))
        won = fated.filter(F.col("fate") == TAKEN)
        done.append(materialize(won.select(*NAMES)))
        # bridges taken together may form long paths: their free ends are those that none of them uses
        path = lambda s: F.least(f"slot_{s}", f"mate_{s}")
        roots = edge_components(won.select(path("a").alias("pa"), path("b").alias("pb")), "pa", "pb")
        sides = won.select(F.explode(F.array(*[F.struct(path(s).alias("v"), F.col(f"{c}_{s}").alias("slot")) for s in "ab" for c in ("slot", "mate")])).alias("x")).select("x.*").distinct()
        used = materialize(won.select(F.explode(F.array("slot_a", "slot_b")).alias("slot")))
        free = sides.join(used, "slot", "left_anti").join(roots, "v").groupBy("root").agg(F.min("slot").alias("s"), F.max("slot").alias("m"))
        mates = materialize(free.select("s", "m").union(free.select("m", "s")))
        o = fated.filter(F.col("fate") == OPEN).drop("fate")
        for s in "ab":
            o = o.join(used.withColumnRenamed("slot", f"slot_{s}"), f"slot_{s}", "left_anti")
            o = o.join(mates.select(F.col("s").alias(f"slot_{s}"), F.col("m").alias("nm")), f"slot_{s}", "left")
            o = o.withColumn(f"mate_{s}", F.coalesce("nm", f"mate_{s}")).drop("nm")
        # both ends of one path: a cycle, now and for ever
        past, open_ = open_, materialize(o.filter("slot_a <> mate_b").select(*open_.columns))
        release(past, fated, used, mates)
    out = cands.select(*NAMES).limit(0)
    for d in done:
        out = out.union(d)
    return out


def greedy_bridges(ends: DataFrame, cands: DataFrame, p: Params = Params(), max_rounds: int = 1_000, bound: int = SOLVED) -> DataFrame:
    """Accepted (frag_a, end_a, frag_b, end_b, cost). ``ends``: frag, length, head, tail.

    An end is looked up again by its voxel, head first: a one-voxel fragment offers its head only. Components of at most
    ``bound`` candidates are decided in one task each.
    """
    c = materialize(_slots(ends, cands, p))
    types = ", ".join(f"{n} {c.schema[n].dataType.simpleString()}" for n in NAMES)
    vids = cands.select(*NAMES, "vid_a", "vid_b", "cost")
    if c.count() <= bound:   # all of them fit a task: their components need not be told apart
        return c.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_decided, types).join(vids, NAMES)
    roots = edge_components(c, "frag_a", "frag_b").select(F.col("v").alias("frag_a"), "root")
    named = materialize(c.join(roots, "frag_a"))
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > bound).select("root")
    parts = max(int(c.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(named.count() / max(bound, 1)))
    small = named.join(large, "root", "left_anti").withColumn("part", F.pmod(F.xxhash64("root"), F.lit(parts)))
    took = small.groupBy("part").applyInPandas(_decided, types)
    if not large.isEmpty():
        took = took.union(_in_rounds(named.join(large, "root", "left_semi"), max_rounds))
    return took.join(vids, NAMES)


def chains(ends: DataFrame, bridges: DataFrame, self_cost: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chain table, membership).

    chain: root (smallest fragment), n_fragments, total_length[, total_cost]; membership: frag, root.
    Lengths count fragment voxels only.
    """
    cc = edge_components(bridges, "frag_a", "frag_b")
    m = ends.select("frag", "length").join(cc.withColumnRenamed("v", "frag"), "frag", "left").select(
        "frag", "length", F.coalesce("root", "frag").alias("root"))
    aggs = [F.count(F.lit(1)).cast("int").alias("n_fragments"), F.sum("length").cast("long").alias("total_length")]
    if self_cost is not None:
        m = m.join(self_cost.select("frag", "self_cost"), "frag", "left")
        aggs.append((F.sum(F.bround(F.col("self_cost") * 1e6).cast("long")) / F.lit(1e6)).alias("total_cost"))
    return m.groupBy("root").agg(*aggs), m.select("frag", "root")


def ranked_chains(chain: DataFrame, min_length: int = 0, name: str = "label") -> DataFrame:
    """Kept chains, numbered from 1 by descending length (ties: earlier first fragment)."""
    return global_rank(chain.filter(F.col("total_length") >= min_length), [F.col("total_length").desc(), F.col("root")], name)
