"""Mixtures: selections of documents in which every source holds its target share of the total size.

Sizes are tokens of a public tokenizer. A mixture's total is cut into blocks of equal size, and the blocks are given to sources one
after another by the highest Sainte-Laguë quotient, weight / (2 * blocks held + 1); a source stops receiving where its cap on repeats
is reached. All documents of a source are taken as many times as fit whole; what remains is given in finer blocks to its bundles of
shards, in proportion to their sizes, and a bundle's blocks to its shards, by the same rule, so that every shard has an integer quota and
no task sees more than the bundles of a source or the shards of a bundle. A shard is a seeded hash of the document, small enough for one
task, so a source with a third of all documents is worked on in many tasks. Within a shard, documents lie in a seeded order that blocks
cut into equal parts; a document belongs to the block that its middle lies in, and the first blocks, as many as the quota, are selected.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable

#: Tokens of a shard, and shares of the total that a block is.
SHARD_TOKENS = 2_000_000
BLOCKS = 10_000
#: Shards in a bundle; a source of 2**40 tokens has some 130 bundles of 4096.
BUNDLE = 4096
#: Rows of a target table, which is gathered; a longer one is refused.
MOST_TARGETS = 100_000


def sainte_lague(weights: list[float], seats: int, caps: list[float] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2k + 1), ties to the earlier; caps bound them; fewer seats if all are at their caps.

    Seats that every claimant surely gets are given at once; the rest one by one.
    """
    caps = [math.inf] * len(weights) if caps is None else caps
    got = [0] * len(weights)
    live = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    left = seats
    while live and left > 2 * len(live):
        total = math.fsum(weights[i] for i in live)
        # a claimant's seats differ from its exact part by less than the number of claimants
        sure = {i: min(caps[i], max(0, math.floor(weights[i] / total * (left + sum(got[j] for j in live))) - len(live))) for i in live}
        gain = {i: int(sure[i]) - got[i] for i in live if sure[i] > got[i]}
        if not gain:
            break
        for i, g in gain.items():
            got[i] += g
            left -= g
        live = [i for i in live if got[i] < caps[i]]
    heap = [(-weights[i] / (2 * got[i] + 1), i) for i in live]
    heapq.heapify(heap)
    while heap and left > 0:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def _split(key: str):
    """Integer quotas of the members (key, size) of one group by Sainte-Laguë; seats and the block size are the same in all of its rows."""

    def run(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values(key).reset_index(drop=True)
        seats, block = int(members["seats"].iloc[0]), float(members["block"].iloc[0])
        sizes = members["size"].astype(float).tolist()
        members["quota"] = sainte_lague(sizes, seats, [math.ceil(s / block) for s in sizes])
        return members.drop(columns=["seats", "size"])

    return run


def shard_quotas(per_shard: DataFrame, planned: DataFrame, n_plan: int) -> DataFrame:
    """(mix, source, shard, turns, block, quota): how often all of a shard is taken, and how many blocks of it besides.

    per_shard has source, shard, size. A source's rest is cut into blocks no larger than the mixture's and at least four for each
    shard, so that rounding stays below one block of the mixture for the source.
    """
    bundles = per_shard.groupBy("source", F.floor(F.col("shard") / BUNDLE).alias("bundle")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    of_source = bundles.groupBy("source").agg(F.sum("n").alias("shards"))
    turns = F.floor(F.col("want_tokens") / F.col("source_tokens"))
    rest = F.greatest(F.lit(0.0), F.col("want_tokens") - turns * F.col("source_tokens"))
    block = F.least(F.col("block_tokens"), F.greatest(F.lit(1.0), rest / (4 * F.col("shards"))))
    wanted = planned.where((F.col("want_tokens") > 0) & (F.col("source_tokens") > 0)).join(of_source, "source")
    wanted = wanted.select("mix", "source", turns.cast("bigint").alias("turns"), block.alias("block"), F.round(rest / block).cast("bigint").alias("seats"))
    wanted = broadcast_if_small(wanted, n_plan)
    named = "mix string, source string, turns bigint, block double"
    first = bundles.join(wanted, "source").select("mix", "source", "turns", "block", "bundle", "seats", "size").groupBy("mix", "source").applyInPandas(_split("bundle"), f"{named}, bundle bigint, quota bigint")
    second = per_shard.withColumn("bundle", F.floor(F.col("shard") / BUNDLE)).join(first.withColumnRenamed("quota", "seats"), ["source", "bundle"])
    second = second.select("mix", "source", "turns", "block", "shard", "seats", "size", "bundle").groupBy("mix", "source", "bundle").applyInPandas(_split("shard"), f"{named}, shard bigint, bundle bigint, quota bigint")
    return second.drop("bundle")


def plan(totals: list[tuple[str, int]], targets: list[dict], total_tokens: int | None = None, blocks: int = BLOCKS) -> list[dict]:
    """What each mix wants of each source: share, block_tokens, blocks, want_tokens, source_tokens, per mix in the given order.

    Both lists are as long as the target table. The total of a mix is `total_tokens`, or else the tokens of its sources with a
    weight. Weights are relative; a null, NaN, infinite or negative weight counts as 0; of a source named twice in a mix the weights add up
    and the smaller cap holds; sources without documents get no blocks, and what they or capped sources leave goes to the others.
    """
    held = dict(totals)
    mixes: dict[str, dict[str, list]] = {}
    for t in targets:
        w = t["weight"]
        w = float(w) if w is not None and math.isfinite(w) and w > 0 else 0.0
        at = mixes.setdefault(t["mix"], {}).setdefault(t["source"], [0.0, math.inf])
        at[0] += w
        at[1] = min(at[1], math.inf if t["max_repeats"] is None else max(0, int(t["max_repeats"])))
    out = []
    for mix, sources in mixes.items():
        names = list(sources)
        weights = [sources[s][0] for s in names]
        tokens = [held.get(s) or 0 for s in names]
        size = total_tokens if total_tokens is not None else sum(n for n, w in zip(tokens, weights) if w > 0)
        block = max(1.0, size / blocks)
        caps = [0 if n == 0 or sources[s][1] == 0 else sources[s][1] if sources[s][1] == math.inf else math.ceil(sources[s][1] * n / block) for s, n in zip(names, tokens)]
        seats = sainte_lague(weights, int(round(size / block)), caps)
        total = math.fsum(weights)
        for s, w, n, k, c in zip(names, weights, tokens, seats, caps):
            most = math.inf if sources[s][1] == math.inf else sources[s][1] * n
            out.append({
                "mix": mix, "source": s, "share": w / total if total else 0.0, "block_tokens": block, "blocks": k,
                "want_tokens": float(min(k * block, most)), "source_tokens": n, "max_repeats": None if sources[s][1] == math.inf else int(sources[s][1]),
            })
    return out


_PLAN = "mix string, source string, share double, block_tokens double, blocks bigint, want_tokens double, source_tokens bigint, max_repeats int"


def quotas(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """The plan as a table. One row per source of the target table is gathered, at most MOST_TARGETS, never one per document."""
    wanted = targets.select("mix", "source", "weight", "max_repeats").where(F.col("mix").isNotNull() & F.col("source").isNotNull())
    listed = [r.asDict() for r in wanted.orderBy("mix", "source", "weight", "max_repeats").limit(MOST_TARGETS + 1).collect()]
    if len(listed) > MOST_TARGETS:
        raise ValueError(f"a target table has at most {MOST_TARGETS} rows")
    known = wanted.select("source").distinct()
    docs = docs.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    sums = docs.join(broadcast_if_small(known, len(listed)), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n"))
    rows = plan([(r.source, r.n) for r in sums.collect()], listed, total_tokens, blocks)
    return docs.sparkSession.createDataFrame([tuple(r.values()) for r in rows], _PLAN)


def select(docs: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: int | None = None, blocks: int = BLOCKS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(mix, doc, source, n_tokens, copies): the documents that each mix uses and how often, at most max_repeats times.

    docs has doc, source, n_tokens and should be durable: it is read more than once. Documents with a null source, or with no
    tokens, are in no mix, repeated documents are documents of their own; the same seed gives the same selection whatever the
    partitioning. Empty tables give an empty one.
    """
    docs = docs.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    planned = quotas(docs, targets, total_tokens, blocks)
    n_plan = planned.count()
    order = F.xxhash64(F.col("doc"), F.lit(seed))
    sized = planned.groupBy("source").agg(F.max("source_tokens").alias("all_tokens"))
    spread = docs.join(broadcast_if_small(sized, n_plan), "source")
    shards = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("all_tokens") / F.lit(float(shard_tokens))))
    spread = spread.select("doc", "source", "n_tokens", order.alias("order"), F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc")), shards).alias("shard"))
    per_shard = durable(spread.groupBy("source", "shard").agg(F.sum("n_tokens").alias("size")))
    given = shard_quotas(per_shard, planned, n_plan)
    before = F.sum("n_tokens").over(W.partitionBy("source", "shard").orderBy("order", "doc").rowsBetween(W.unboundedPreceding, -1))
    laid = spread.withColumn("middle", F.coalesce(before, F.lit(0)) + F.col("n_tokens") / 2)
    # blocks are numbered along the seeded order, a middle on a border belonging to the block before it; the first are the selected ones
    block = F.ceil(F.col("middle") / F.col("block")) - 1
    taken = laid.join(given, ["source", "shard"]).withColumn("copies", F.col("turns") + (block < F.col("quota")).cast("bigint"))
    caps = planned.select("mix", "source", "max_repeats")
    taken = taken.join(broadcast_if_small(caps, n_plan), ["mix", "source"])
    copies = F.least(F.col("copies"), F.coalesce(F.col("max_repeats").cast("bigint"), F.col("copies")))
    return taken.select("mix", "doc", "source", "n_tokens", copies.alias("copies")).where(F.col("copies") > 0)


def shares(selected: DataFrame, docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """mix, source, target_share, blocks, source_tokens, docs_used, used_tokens, share, repeats: one row per source of a mix.

    share is of the tokens selected for the mix; repeats is used_tokens by source_tokens.
    """
    docs = docs.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    planned = quotas(docs, targets, total_tokens, blocks)
    used = selected.groupBy("mix", "source").agg(F.count("*").alias("docs_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    joined = planned.join(used, ["mix", "source"], "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0).cast("bigint")))
    all_ = F.sum("used_tokens").over(W.partitionBy("mix"))
    return joined.select(
        "mix", "source", F.col("share").alias("target_share"), "blocks", "source_tokens", F.coalesce("docs_used", F.lit(0).cast("bigint")).alias("docs_used"), "used_tokens",
        F.when(all_ > 0, F.col("used_tokens") / all_).otherwise(0.0).alias("share"),
        F.when(F.col("source_tokens") > 0, F.col("used_tokens") / F.col("source_tokens")).otherwise(0.0).alias("repeats"),
    )


def sized(docs: DataFrame, key: str, source: str, text: str, path: str | None = None) -> DataFrame:
    """(doc, source, n_tokens), durable: the token counts of whole texts by a public tokenizer."""
    from . import tokens

    more = {"path": path} if path else {}
    counted = tokens.count(docs.select(F.col(key).alias("doc"), F.col(source).alias("source"), F.col(text).alias("text")), ["doc", "source"], "text", **more)
    return durable(counted)
