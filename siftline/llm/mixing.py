"""Mixing sources to target weights by entropy balancing.

The balanced rates minimise the relative entropy to the corpus, each document
weighed by its tokens, under one token constraint a source.  The dual of that
problem is convex; Newton's method solves it with gradients and curvatures
summed by Spark over all documents.  A document's rate is the exponential of its
source's multiplier; rates are then rounded into whole copies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import durable

#: The most sources of which a row each is broadcast.
BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Target tokens of each source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all tokens; a target stops at
    ``most`` times its source's size, and what is above goes to the others by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    out, open_ = {}, list(names)
    while open_:
        left = total - sum(out.values())
        whole = sum(weigh[s] for s in open_)
        above = [s for s in open_ if left * weigh[s] / whole > most * sizes[s]]
        if not above:
            return out | {s: left * weigh[s] / whole for s in open_}
        out |= {s: float(most * sizes[s]) for s in above}
        open_ = [s for s in open_ if s not in out]
    return out


def _few(rows: DataFrame, n: int) -> DataFrame:
    """A row a source: broadcast if they are few, else joined by shuffle."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def balance(sized: DataFrame, goal: dict, size: str = "size", source: str = "source", tolerance: float = 1e-9, rounds: int = 30) -> dict:
    """Multipliers of the dual: for each source the logarithm of its documents' rate.

    The dual is sum(size * exp(multiplier of the source)) - sum(multiplier * target).  Each Newton round is one
    aggregation over all documents, which returns a row a source; steps are damped to 2.  Sources whose target or size
    is 0 get minus infinity.
    """
    held = {s: 0.0 for s, t in goal.items() if t > 0}
    for _ in range(rounds):
        if not held:
            break
        rates = sized.sparkSession.createDataFrame([(s, m) for s, m in held.items()], f"`{source}` string, _multiplier double")
        tilted = sized.join(_few(rates, len(held)), sized[source].eqNullSafe(rates[source])).select(rates[source].alias("s"), (F.col(size) * F.exp("_multiplier")).alias("w"))
        mass = {r["s"]: r["w"] for r in tilted.groupBy("s").agg(F.sum("w").alias("w")).collect()}
        worst = 0.0
        for s in list(held):
            if not mass.get(s):
                del held[s]
                continue
            gradient = mass[s] - goal[s]  # the curvature is the same sum, mass[s]
            worst = max(worst, abs(gradient) / goal[s])
            held[s] -= max(-2.0, min(2.0, gradient / mass[s]))
        if worst < tolerance:
            break
    return {s: held.get(s, -math.inf) for s in goal}


def _round_copies(group: pd.DataFrame) -> pd.DataFrame:
    """Whole copies: the fraction of a rate is carried as tokens from document to document, the longest first."""
    group = group.sort_values(["size", "_order", "doc_id"], ascending=[False, True, True], kind="stable")
    rate = np.minimum(group["_rate"].to_numpy(), group["_most"].to_numpy())
    base, size = np.floor(rate + 1e-9), group["size"].to_numpy()
    extra, due, owed = np.zeros(len(group), np.int64), (rate - base).clip(0) * size, 0.0
    for i, (n, d) in enumerate(zip(size.tolist(), due.tolist(), strict=True)):
        owed += d
        if d and 2 * owed >= n:
            extra[i], owed = 1, owed - n
    out = group.drop(columns=["_rate", "_most", "_bucket"])
    out["copies"] = base.astype(np.int64) + extra
    return out


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, rows_a_group: int = 10_000, keep_order: bool = False) -> DataFrame:
    """One row for each input row: doc_id, source, size (words), source_size, target (its source's), rate, copies, taken.

    Sizes are counted over whole texts; null and empty texts have size 0 and no copies taken count (0 words).  A null
    source is a source of its own, the last.  No document gets more than ``most`` copies.  A source's documents are
    rounded in groups of about ``rows_a_group``, dealt by a hash of key and row, so a source that holds most rows is
    spread over many tasks; in each group the taken words miss the rate by half a short document at most.  Repeated
    rows are rounded one by one and reruns agree.  ``key`` must be an integer; it is returned as long.  The number of sources must fit the driver; rows need not.
    No rows in, none out.
    """
    plain = df.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(key), F.col(text)).alias("_order"))
    sized = durable(plain)
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes = {r["source"]: r["size"] for r in totals}
    goal = targets(sizes, weights, share, most)
    multiplier = balance(sized, goal)
    rows = [(r["source"], r["size"], float(goal[r["source"]]), min(float(most), math.exp(multiplier[r["source"]])), max(1, -(-r["n"] // rows_a_group))) for r in totals]
    if not rows:
        rows = [(None, 0, 0.0, 0.0, 1)]
    known = sized.sparkSession.createDataFrame(rows, "s string, source_size long, target double, _rate double, _buckets int")
    joined = sized.join(_few(known, len(rows)), sized["source"].eqNullSafe(known["s"])).drop("s").withColumn("_most", F.lit(float(most)))
    dealt = joined.withColumn("_bucket", F.pmod(F.col("_order"), F.col("_buckets"))).drop("_buckets")
    schema = "doc_id long, source string, size long, _order long, source_size long, target double, copies long"
    mixed = dealt.groupBy("source", "_bucket").applyInPandas(_round_copies, schema).withColumn("taken", F.col("copies") * F.col("size"))
    return mixed if keep_order else mixed.drop("_order")


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that the mix takes, each as often as it is taken, with the columns of ``df``.

    Rows that agree in key and text share their copies as evenly as can be.  Null and empty texts have size 0, owe
    nothing and are taken as often as their source's whole copies say; rows of null key or source are mixed like others; texts are
    read whole; columns may have any names; no rows in, none out.
    """
    # the row travels as one struct, whatever its columns are called
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(key).cast("long").alias("key"), F.xxhash64(F.col(key), F.col(text)).alias("match"))
    mixed = mix(df, key, text, keep_order=True, **options)
    taken = mixed.groupBy(F.col("doc_id").alias("taken_key"), F.col("_order").alias("taken_match")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    # dealt by the hash alone, so that the numbering of equal rows needs no second shuffle
    same = F.coalesce(held["key"] == taken["taken_key"], held["key"].isNull() & taken["taken_key"].isNull())
    turn = F.row_number().over(Window.partitionBy("match", "taken_key").orderBy("match")) - 1
    each = held.join(taken, (held["match"] == taken["taken_match"]) & same).withColumn("own", F.floor((F.col("copies") + F.col("rows") - 1 - turn) / F.col("rows")).cast("int"))
    return each.where("own > 0").withColumn("own", F.explode(F.sequence(F.lit(1), F.col("own")))).select("row.*")
