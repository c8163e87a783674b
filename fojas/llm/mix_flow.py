"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are added up by membership pattern, the set of sources that offer them. A flow then routes
the patterns' capacity to the sources' quotas. A pattern's words can flow ``layers`` times; the first
pass is free and each further one costs more, so words are repeated only where fresh ones don't fill
the quotas. Within a pattern whole documents are taken in seeded order up to the routed amount. Those that
don't fit into what is left are passed over, until no document fits.

The driver sees sums by pattern and no rows. Documents are judged in place by cut-offs of their pattern.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fojas.llm.common import written

BIN_SHIFT = 52  # 4,096 bins of the signed hash
LAST = 2**63 - 1
PASSES = "passes_ array<struct<after: long, upto: long, most: long>>"


def route(sizes: list[int], members: list[list[int]], quotas: list[int], layers: int) -> list[dict[int, int]]:
    """Words of each pattern for each source: a maximum flow of least cost.

    All cost lies on the arcs into patterns, each layer dearer than the last. Augmenting with the arcs
    of one layer after the other is therefore least in cost: flow that has entered is never withdrawn.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    room = list(quotas)
    holders: dict[int, list[int]] = {}
    for p, own in enumerate(members):
        for s in own:
            holders.setdefault(s, []).append(p)
    for _ in range(layers):
        for p, left in enumerate(sizes):
            while left > 0:
                came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None}
                queue, end = deque([("p", p)]), None
                while queue and end is None:
                    kind, x = queue.popleft()
                    if kind == "p":
                        nexts = [("s", s) for s in members[x]]
                    elif room[x] > 0:
                        end = ("s", x)
                        break
                    else:
                        nexts = [("p", q) for q in holders[x] if flow[q][x] > 0]
                    for y in nexts:
                        if y not in came:
                            came[y] = (kind, x)
                            queue.append(y)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                amount = min(left, room[end[1]])
                for a, b in zip(path, path[1:]):
                    if a[0] == "s":
                        amount = min(amount, flow[b[1]][a[1]])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        flow[a[1]][b[1]] += amount
                    else:
                        flow[b[1]][a[1]] -= amount
                room[end[1]] -= amount
                left -= amount
    return flow


def quotas_by_weight(sizes: dict[str | None, int], weights: dict[str | None, float], share: float, most: float) -> dict[str | None, float]:
    """Targets: ``share`` of all sizes by weight; none over ``most`` times its source's size, the excess
    reshared by weight among the others until none is above."""
    left, open_ = share * sum(sizes.values()), [s for s in sizes if weights[s] > 0]
    out = dict.fromkeys(sizes, 0.0)
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weights[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
        left = max(0.0, left)
    return out


def mix(docs: DataFrame, quotas: dict[str | None, float], seed: int = 1, layers: int = 2, most_patterns: int = 100_000) -> DataFrame:
    """(id, size, sources array<string>) plus ``copies`` and ``taken``, and all other columns as they are.

    ``taken`` is size times copies, at most ``layers`` times the size. Selection goes by a seeded hash of
    the id alone, so reruns agree; rows with one id are taken together. Null and empty ``sources`` belong
    to no source and are not taken; a null element is the source null. Sizes null or below 1 count 0.
    Sources without quota get nothing; an empty table gives none. The columns ``copies`` and ``taken``
    are replaced if present. More than ``most_patterns`` membership patterns are refused, since quotas
    are set by hand for few sources.
    """
    spark = docs.sparkSession
    docs = docs.drop("copies", "taken")
    pattern = F.array_sort(F.array_distinct(F.coalesce(F.col("sources"), F.array().cast("array<string>"))))
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long")
    rows = docs.select(pattern.alias("p_"), F.xxhash64("id", F.lit(seed)).alias("h_"), size.alias("size_"))
    units = written(rows.groupBy("p_", "h_").agg(F.sum("size_").alias("size_"), F.count("*").alias("rows_")), "units")
    found = units.groupBy("p_").agg(F.sum("size_").alias("n")).orderBy("p_").limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    sources = sorted({s for r in found for s in r.p_}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(sources)}
    flow = route([r.n for r in found], [[place[s] for s in r.p_] for r in found], [int(quotas.get(s, 0)) for s in sources], layers)
    plan = []
    for r, out in zip(found, flow):
        amount = sum(out.values())
        full = min(layers, amount // r.n) if r.n else 0
        plan.append((r.p_, int(full), int(amount - full * r.n)))
    cuts = _cut_offs(spark, units, [x for x in plan if x[2] > 0])
    taken = f"p_ array<string>, full_ long, {PASSES}, fill_ long"
    table = spark.createDataFrame([(p, full, *cuts.get(_key(p), ([], None))) for p, full, _ in plan], taken)
    out = docs.withColumns({"p_": pattern, "h_": F.xxhash64("id", F.lit(seed)), "size_": size}).join(F.broadcast(table), "p_", "left")
    several = units.filter("rows_ > 1").select(F.col("p_").alias("q_"), F.col("h_").alias("g_"), F.col("size_").alias("all_"))
    if several.isEmpty():
        out = out.withColumn("all_", F.col("size_"))
    else:
        out = out.join(several, (F.col("p_") == F.col("q_")) & (F.col("h_") == F.col("g_")), "left").withColumn("all_", F.coalesce("all_", "size_")).drop("q_", "g_")
    once_more = F.coalesce(_taken("all_"), F.lit(False)) | F.coalesce(F.col("h_") == F.col("fill_"), F.lit(False))
    out = out.withColumn("copies", (F.coalesce("full_", F.lit(0)) + once_more.cast("long")).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size_")).drop("p_", "h_", "size_", "all_", "full_", "passes_", "fill_")


def _key(pattern: list) -> tuple:
    return tuple(pattern)


def _taken(size: str) -> Column:
    return F.exists("passes_", lambda x: (x["after"].isNull() | (F.col("h_") > x["after"])) & (F.col("h_") <= x["upto"]) & (F.col(size) <= x["most"]))


def _cut_offs(spark, units: DataFrame, plan: list[tuple]) -> dict[tuple, tuple[list[tuple[int | None, int, int]], int | None]]:
    """For each pattern with a rest: passes (after, up to, most) whose units are taken once more, by hash
    and size, and the hash of a last one.

    A pass goes in hash order over the units after the last pass that are no larger than what is left, up
    to the first that no longer fits: by sums of 4,096 hash bins, then within the one bin it ends in. What
    was passed over is larger than all that is left, so when no unit is found none fits anywhere. Each
    pass takes a unit at least. The last one is larger than what is left by less than that.
    """
    state = {_key(p): {"p": p, "after": None, "left": rest, "passes": []} for p, _, rest in plan}
    upto = Window.partitionBy("p_").orderBy("bin")
    active = list(state.values())
    while active:
        rows = F.broadcast(spark.createDataFrame([(s["p"], s["after"], s["left"]) for s in active], "p_ array<string>, after long, left long"))
        free = units.join(rows, "p_").filter((F.col("after").isNull() | (F.col("h_") > F.col("after"))) & (F.col("size_") <= F.col("left"))).withColumn("bin", F.shiftright("h_", BIN_SHIFT))
        bins = free.groupBy("p_", "left", "bin").agg(F.sum("size_").alias("n")).withColumn("upto", F.sum("n").over(upto))
        end = F.min(F.when(F.col("upto") > F.col("left"), F.struct("bin", (F.col("left") - (F.col("upto") - F.col("n"))).alias("room"))))
        ends = {_key(r.p_): r for r in bins.groupBy("p_").agg(end.alias("b"), F.sum("n").alias("total")).collect()}
        at = [(list(p), r.b.bin, r.b.room) for p, r in ends.items() if r.b is not None]
        last = {}
        if at:
            inside = free.join(F.broadcast(spark.createDataFrame(at, "p_ array<string>, bin long, room long")), ["p_", "bin"])
            inside = inside.withColumn("upto", F.sum("size_").over(Window.partitionBy("p_").orderBy("h_"))).filter("upto <= room")
            last = {_key(r.p_): r for r in inside.groupBy("p_").agg(F.max("h_").alias("h"), F.sum("size_").alias("n")).collect()}
        going = []
        for s in active:
            r = ends.get(_key(s["p"]))
            if r is None:
                continue
            if r.b is None:
                s["passes"].append((s["after"], LAST, s["left"]))
                s["left"] -= r.total
                continue
            found = last.get(_key(s["p"]))
            to, n = (found.h, found.n) if found else ((r.b.bin << BIN_SHIFT) - 1, 0)
            s["passes"].append((s["after"], to, s["left"]))
            s["after"], s["left"] = to, r.b.room - n
            if s["left"] > 0:
                going.append(s)
        active = going
    short = [(s["p"], s["left"], s["passes"]) for s in state.values() if s["left"] > 0]
    fill = {}
    if short:
        # up to twice what is left: taking it misses the amount by less than leaving it does
        near = units.join(F.broadcast(spark.createDataFrame(short, f"p_ array<string>, left long, {PASSES}")), "p_").filter((F.col("size_") > 0) & (F.col("size_") < 2 * F.col("left")) & ~_taken("size_"))
        fill = {_key(r.p_): r.b.h_ for r in near.groupBy("p_").agg(F.min(F.struct("size_", "h_")).alias("b")).collect()}
    return {k: (s["passes"], fill.get(k)) for k, s in state.items()}


def word_count(text: str) -> Column:
    """Runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = (3, 1, 2)) -> dict[str | None, tuple[int, float]]:
    """(source, size) rows to each source's size and target; sources by code point, null last, weigh ``cycle`` in turn."""
    sums = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    targets = quotas_by_weight({s: sums[s] for s in order}, {s: cycle[i % len(cycle)] for i, s in enumerate(order)}, share, most)
    return {s: (sums[s], targets[s]) for s in order}
