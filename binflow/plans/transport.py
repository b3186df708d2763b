"""Optimal transport plan by an auction with falling bid steps.

Maximises the sum of (URGENCY * score - kilometres) over the moved containers, with each donor's
supply and each receiver's demand as bounds. Receivers bid for the containers of donors in reach,
each unit of a site with its own price. So that nobody is left over, every site also has a
stand-in: a receiver may take its own instead of a container, a donor's takes the container that
nobody wants, and for each move the stand-ins of both sides pair up along the same edge. Bids
rise by at least the step; with whole-number benefits and a last step below one over the number
of bidders the plan is optimal.

Bids meet in tasks. A component of the edges that is small enough is settled in one task, all
components at once. A larger one is cut into tiles of nearby bidders, and a round settles every
tile against the prices of all; of the bids on a site its units go to the highest, and who is
outbid bids again. Prices only rise within a step, so a tile's view is never too dear.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binflow.plans.clustering import connected
from binflow.session import cut

#: Kilometres that a point of score is worth: a fixed value, far above any distance.
URGENCY = 1000.0
#: Benefits are whole millionths of a kilometre.
UNIT = 1_000_000
#: Each step is this part of the one before.
FALL = 6
#: Arcs that a task settles; larger components are cut into tiles of side TILE degrees.
ARCS, TILE = 200_000, 0.02
STATE = "o bigint, price bigint, p bigint, u int"


def bid_steps(most: int) -> list[int]:
    """Falling bid steps, the last one 1."""
    steps, step = [], max(1, most // 2)
    while step > 1:
        steps.append(step)
        step = max(1, step // FALL)
    return [*steps, 1]


def settle(arcs: pd.DataFrame, units: pd.DataFrame, steps: list[int]) -> pd.DataFrame:
    """Bids until every bidder of `arcs` has a unit: the units that changed hands.

    arcs: (p, o, b, n), bidder, object, benefit and the bidder's number of units; units: (o,
    price, p, u), the unit's holder, p -1 for none. Each further step begins without holders.
    """
    arcs = arcs.sort_values(["p", "o"])
    objects, place = np.unique(units["o"].to_numpy(), return_inverse=True)
    heaps: list[list[tuple[int, int, int]]] = [[] for _ in objects]
    for o, price, p, u in zip(place.tolist(), units["price"].tolist(), units["p"].tolist(), units["u"].tolist(), strict=True):
        heaps[o].append((price, p, u))
    options, sizes = {}, {}
    for p, rows in arcs.groupby("p", sort=True):
        options[p] = (np.searchsorted(objects, rows["o"].to_numpy()), rows["b"].to_numpy())
        sizes[p] = int(rows["n"].iloc[0])
    none = np.iinfo(np.int64).min // 4
    changed = set()
    for turn, step in enumerate(steps):
        if turn:
            heaps = [[(price, -1, k) for k, (price, _, _) in enumerate(h)] for h in heaps]
            changed = set()
        for h in heaps:
            heapq.heapify(h)
        low = np.array([h[0][0] for h in heaps], np.int64)
        next_low = lambda h: min(h[1:3])[0] if len(h) > 1 else -none
        above = np.array([next_low(h) for h in heaps], np.int64)
        held = {(p, u) for h in heaps for _, p, u in h if p >= 0}
        waiting = [(p, u) for p in reversed(options) for u in range(sizes[p]) if (p, u) not in held]
        while waiting:
            p, u = waiting.pop()
            at, benefit = options[p]
            gain = benefit - low[at]
            k = int(gain.argmax())
            best, o = int(gain[k]), int(at[k])
            gain[k] = none
            second = max(int(gain.max()), int(benefit[k] - above[o]), none)
            price = int(low[o]) + (best - second if second > none // 2 else step) + step
            _, out, unit = heapq.heapreplace(heaps[o], (price, p, u))
            changed.discard((out, unit))
            changed.add((p, u))
            if out >= 0:
                if out in options:
                    waiting.append((out, unit))
            low[o], above[o] = heaps[o][0][0], next_low(heaps[o])
    every = [(int(objects[o]), price, p, u) for o, h in enumerate(heaps) for price, p, u in h if len(steps) > 1 or (p, u) in changed]
    return pd.DataFrame(every, columns=["o", "price", "p", "u"]).astype({"o": "int64", "price": "int64", "p": "int64", "u": "int32"})


def _tiles(nodes: DataFrame, arcs: DataFrame, places: DataFrame | None, limit: int) -> DataFrame:
    """(p, tile): tiles of a component that is too large for a task: bidders of one cell, dealt
    further by their id while a cell has too many arcs."""
    if places is None:
        cells = nodes.select("node", F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    else:
        site = F.floor(F.col("node") / 2)
        at = places.select(F.col("site_id").alias("_s"), F.floor(F.col("longitude") / TILE).alias("cx"), F.floor(F.col("latitude") / TILE).alias("cy"))
        cells = nodes.join(at, site == F.col("_s"), "left").select("node", F.coalesce("cx", F.lit(0)).alias("cx"), F.coalesce("cy", F.lit(0)).alias("cy"))
    cells = cells.join(arcs.groupBy(F.col("p").alias("node")).agg(F.count("*").alias("arcs")), "node")
    loads = cells.groupBy("cx", "cy").agg(F.ceil(F.sum("arcs") / limit).alias("deal"))
    dealt = F.pmod(F.xxhash64("node"), F.col("deal"))
    return cells.join(loads, ["cx", "cy"]).select(F.col("node").alias("p"), F.xxhash64("cx", "cy", dealt).alias("tile"))


def transport_plan(edges: DataFrame, supply: DataFrame, demand: DataFrame, places: DataFrame | None = None, arcs_per_task: int = ARCS) -> DataFrame:
    """(donor_id, receiver_id, distance_km, score, amount): a plan of the greatest total benefit.

    edges: (donor_id, receiver_id, distance_km, score), one row for each pair in reach; supply:
    (donor_id, supply); demand: (receiver_id, demand); places: (site_id, latitude, longitude).
    Ids are natural numbers. Without pairs, supply or demand there are no rows. Of equally good plans the result is one,
    the same for the same input.
    """
    spark = edges.sparkSession
    pairs = edges.join(supply.where("supply > 0"), "donor_id").join(demand.where("demand > 0"), "receiver_id")
    worth = (F.round(F.col("score") * (URGENCY * UNIT)) - F.round(F.col("distance_km") * UNIT)).cast("bigint")
    pairs = cut(pairs.select("donor_id", "receiver_id", "distance_km", "score", "supply", "demand", worth.alias("b")))
    donor, receiver = F.col("donor_id") * 2, F.col("receiver_id") * 2 + 1
    nodes = cut(
        pairs.select(donor.alias("node"), F.col("supply").alias("n")).unionByName(pairs.select(receiver.alias("node"), F.col("demand").alias("n"))).distinct()
    )
    arc = lambda p, o, b, n: F.struct(p.alias("p"), o.alias("o"), b.alias("b"), n.cast("int").alias("n"))
    zero = F.lit(0).cast("bigint")
    both = pairs.select(F.explode(F.array(arc(receiver, donor, F.col("b"), F.col("demand")), arc(donor, receiver, zero, F.col("supply")))).alias("a")).select("a.*")
    own = nodes.select(F.col("node").alias("p"), F.col("node").alias("o"), zero.alias("b"), F.col("n").cast("int").alias("n"))
    arcs = cut(both.unionByName(own))
    links = pairs.select(donor.alias("node"), receiver.alias("other"))
    labels = connected(nodes.select("node"), links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))))
    named = arcs.join(labels.withColumnsRenamed({"node": "p", "label": "part"}), "p")
    sizes = named.groupBy("part").agg(F.count("*").alias("arcs"))
    named = cut(named.join(sizes, "part"))
    start = nodes.select(F.col("node").alias("o"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("u"), F.lit(-1).cast("bigint").alias("p"), zero.alias("price"))

    def closed(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.drop_duplicates("p")
        bidders = int(first["n"].sum())
        rows["b"] *= bidders + 1
        units = pd.DataFrame({"o": np.repeat(first["p"].to_numpy(), first["n"]), "price": 0, "p": -1})
        units["u"] = np.arange(len(units))
        return settle(rows, units, bid_steps(int(rows["b"].abs().max())))

    state = cut(named.where(F.col("arcs") <= arcs_per_task).groupBy("part").applyInPandas(closed, STATE))
    large = named.where(F.col("arcs") > arcs_per_task)
    if not large.isEmpty():
        state = state.unionByName(_in_rounds(large, start, nodes, places, arcs_per_task))
    taken = state.where((F.pmod("p", F.lit(2)) == 1) & (F.pmod("o", F.lit(2)) == 0) & (F.col("p") != -1))
    amounts = taken.groupBy(F.floor(F.col("o") / 2).alias("donor_id"), F.floor((F.col("p") - 1) / 2).alias("receiver_id")).agg(F.count("*").alias("amount"))
    return pairs.select("donor_id", "receiver_id", "distance_km", "score").join(amounts, ["donor_id", "receiver_id"])


def _in_rounds(arcs: DataFrame, start: DataFrame, nodes: DataFrame, places: DataFrame | None, limit: int) -> DataFrame:
    """The settled units of components that no single task takes."""
    bidders = arcs.select("p", "n").distinct().agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first().n
    own = arcs.select(F.col("p").alias("node")).distinct()
    tiles = cut(_tiles(own, arcs, places, limit))
    arcs = cut(arcs.select("p", "o", (F.col("b") * (bidders + 1)).alias("b"), "n").join(tiles, "p"))
    seen = cut(arcs.select(F.col("tile").alias("to"), F.col("o").alias("object")).distinct())
    size = nodes.select(F.col("node").alias("o"), F.col("n").alias("cap"))
    state = cut(start.join(own.withColumnRenamed("node", "o"), "o", "left_semi").select("o", "price", "p", "u"))
    keep = Window.partitionBy("o").orderBy(F.desc("price"), F.desc("p"), F.desc("u"))
    def by(step: int):
        def run(rows: pd.DataFrame, units: pd.DataFrame) -> pd.DataFrame:
            return settle(rows, units, [step])

        return run

    for step in bid_steps(arcs.agg(F.max(F.abs("b"))).first()[0]):
        state = cut(state.select("o", "price", F.lit(-1).cast("bigint").alias("p"), (F.row_number().over(Window.partitionBy("o").orderBy("price", "u")) - 1).alias("u")))
        while state.where("p >= 0").count() < bidders:
            view = seen.join(state, F.col("object") == F.col("o")).select("to", F.col("object").alias("o"), F.col("price").alias("price"), F.col("p").alias("p"), F.col("u").alias("u"))
            bids = arcs.groupBy("tile").cogroup(view.groupBy("to")).applyInPandas(by(step), STATE)
            every = state.unionByName(bids).join(size, "o").withColumn("rank", F.row_number().over(keep))
            state = cut(every.where("rank <= cap").select("o", "price", "p", "u"))
    return state
