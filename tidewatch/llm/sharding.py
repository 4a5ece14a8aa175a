"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

Nodes have a size, edges link nodes. Linked nodes start at hashed shards. In each round a node's
edges vote for the shards of its neighbours (a join and a combining count); nodes that would gain
propose to move. A shard accepts proposals, largest gains first, up to the room it has: demand is
summed per shard and gain class, a few hundred rows, and of the last class that fits only in part it
takes the proposals whose hash lies below the share of room. Rounds alternate between
moves to lower and to higher shards, so two nodes never swap for ever. What then exceeds a shard's
fair size is released, and released and unlinked nodes fill the shards: largest first, each class
laid along the shards' missing bytes by running totals, so what one class leaves uneven, smaller
nodes even out. Only sums per shard and size class reach the driver, and the groups named next.

Documents (``grouped_shards``): equal texts are one node, a unit, which moves, is released and is filled
in whole. Units are linked by the pieces (sentences or lines) they share. A piece's members don't become
pairs: members are counted per piece and shard, at most one number a shard, and each member hears those
counts, less itself, divided by the number of the others, so a piece's word is one vote however common
it is and a piece of every document says next to nothing. Pieces with the same members are one bundle
that counts as often as it has pieces. A bundle's counts go to its members by salted keys, so a piece that
a third of all documents hold is spread. While units move, a shard may hold ROOMY times its fair size;
then those held by the fewest votes are released first.
Groups above 1/BIG of a fair shard, at most BIG times the shards, are placed first: largest first, whole
where they fit the shard with most room, otherwise over the shards with most room in turn. They don't
move, but what shares a piece with them hears the shard of their first part.

Defined cases: a null text has size 1 and no links, a text without a piece of SHORTEST characters has
none either; repeated rows are equal texts; a node larger than a fair shard makes its shard that much larger; an empty table gives
an empty result; other input columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.common import documents, given_up, written
from tidewatch.llm.registry import query

SHARDS = 16
ROUNDS = 10
FULL = 0.97
SPOKES = 64
ROWS_PER_BUCKET = 4096
MOST_BUCKETS = 4096
FILL_SHARES = (0.3, 0.05)
CELLS = 256
BIG = 64
PIECE = "[.!?\\n\u3002\uff01\uff1f]+"
SHORTEST = 20  # characters of a piece that links
VOTE = 1_000_000_000  # one vote in whole numbers
HOT = 4096  # members of a bundle that hear its counts under one key
ROOMY = 1.25


def equal_value_edges(nodes: DataFrame, value: str) -> DataFrame:
    """(a, b) edges that connect nodes of equal ``value`` by two-step stars, both ways, without hot nodes.

    The least node of a value is its hub; a value's nodes fall into SPOKES classes, whose least nodes
    are tied to the hub and the others to them.
    """
    keyed = nodes.where(F.col(value).isNotNull()).select("node", value, F.pmod(F.xxhash64("node"), F.lit(SPOKES)).alias("spoke"))
    spokes = keyed.groupBy(value, "spoke").agg(F.min("node").alias("mid"))
    hubs = spokes.groupBy(value).agg(F.min("mid").alias("hub"), F.count(F.lit(1)).alias("n"))
    mids = spokes.join(hubs, value)
    outer = keyed.join(spokes, [value, "spoke"]).where("node <> mid").select(F.col("node").alias("a"), F.col("mid").alias("b"))
    inner = mids.where("mid <> hub").select(F.col("mid").alias("a"), F.col("hub").alias("b"))
    one_way = outer.unionByName(inner)
    return one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _shard_of(column: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit("start")), F.lit(shards)).cast("int")


def _loads(nodes: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["size"] for r in nodes.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(linked: DataFrame, edges: DataFrame, shards: int, capacity: float, rounds: int = ROUNDS) -> DataFrame:
    """(node, size, shard) of the linked nodes after label propagation; both inputs are read in every round."""
    state = linked.select("node", "size", _shard_of("node", shards).alias("shard"))

    def facing(state: DataFrame) -> DataFrame:
        votes = edges.join(state.select(F.col("node").alias("b"), F.col("shard").alias("to")), "b").groupBy("a", "to").agg(F.count(F.lit(1)).alias("votes"))
        heard = votes.groupBy("a").agg(F.max(F.struct("votes", (-F.col("to")).alias("low"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("to", "votes"))).alias("all"))
        gain = F.col("best.votes") - F.coalesce(F.col("all")[F.col("shard")], F.lit(0))
        return state.join(heard, state["node"] == heard["a"], "left").select(*state.columns, (-F.col("best.low")).cast("int").alias("to"), gain.alias("gain"))

    return _turns(state, facing, shards, [0] * shards, capacity, rounds)


def pieces(text: Column) -> Column:
    """Hashes of a text's distinct sentences and lines of at least SHORTEST characters."""
    cut = F.filter(F.transform(F.split(text, PIECE), F.trim), lambda p: F.length(p) >= SHORTEST)
    return F.array_distinct(F.transform(cut, lambda p: F.xxhash64(p)))


def bundled(held: DataFrame) -> DataFrame:
    """Links (node, bundle, n, weight, vote, salt) of ``held`` (node, piece), a written table of distinct rows.

    A bundle stands for ``weight`` pieces with the same ``n`` >= 2 nodes; ``vote`` is what each other node counts.
    """
    celled = held.withColumn("cell", F.pmod(F.xxhash64("node", F.lit("cell")), F.lit(CELLS)).cast("int"))
    parts = written(celled.groupBy("piece", "cell").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"), F.min("node").alias("least")), "shards-pieces")
    whole = parts.groupBy("piece").agg(F.sum("n").alias("n"), F.bit_xor("who").alias("who"), F.min("least").alias("least")).where("n > 1")
    named = parts.select("piece", "cell").join(whole.select("piece", "n", F.xxhash64("n", "who", "least").alias("bundle")), "piece")
    # A piece's members meet its bundle by cell, so that a piece of very many members is CELLS keys.
    links = celled.join(named, ["piece", "cell"]).groupBy("node", "bundle", "n").agg(F.count(F.lit(1)).alias("weight"))
    vote = F.floor(F.col("weight") * F.lit(VOTE) / (F.col("n") - 1)).cast("bigint")
    return written(links.select("node", "bundle", "n", "weight", vote.alias("vote"), F.pmod(F.xxhash64("node", F.lit("salt")), _salts()).alias("salt")), "shards-links")


def _salts() -> Column:
    return F.ceil(F.col("n") / HOT).cast("bigint")


def heard(links: DataFrame, voters: DataFrame, shards: int) -> DataFrame:
    """(node, all): votes per shard, an array by shard, that reach a node through its bundles, its own included.

    Counts lie in one column a shard, as shards are some tens, so each step is one combining aggregate.
    """
    counts = [f"c{s}" for s in range(shards)]
    met = links.select("node", "bundle", "n").join(voters.select("node", "shard"), "node")
    told = met.groupBy("bundle", "n").agg(*[F.count_if(F.col("shard") == s).alias(c) for s, c in enumerate(counts)])
    told = told.select("bundle", *counts, F.explode(F.sequence(F.lit(0).cast("bigint"), _salts() - 1)).alias("salt"))
    votes = links.join(told, ["bundle", "salt"]).groupBy("node").agg(*[F.sum(F.col("vote") * F.col(c)).alias(c) for c in counts])
    return votes.select("node", F.array(*counts).alias("all"))


def own_votes(links: DataFrame) -> DataFrame:
    """(node, own): what a node says to itself, to be taken off what it hears; the same in all rounds."""
    return links.groupBy("node").agg(F.sum("vote").alias("own"))


def propagate_units(units: DataFrame, links: DataFrame, fixed: DataFrame, shards: int, placed: list[int], capacity: float, rounds: int = ROUNDS) -> DataFrame:
    """(node, size, own, shard) of the linked ``units`` (node, size, own) after rounds of moves.

    ``fixed`` (node, shard) are nodes that are heard but don't move, ``placed`` the bytes that lie in each shard already.
    """
    state = units.select("node", "size", "own", _shard_of("node", shards).alias("shard"))

    def facing(state: DataFrame) -> DataFrame:
        voters = state.select("node", "shard").unionByName(fixed)
        met = state.join(heard(links, voters, shards), "node", "left")
        # A node doesn't hear itself.
        others = F.transform("all", lambda v, s: F.struct((v - F.when(s == F.col("shard"), F.col("own")).otherwise(0)).alias("votes"), (-s).alias("low")))
        best = F.array_max(others)
        return met.select(*state.columns, (-best["low"]).cast("int").alias("to"), (best["votes"] - F.col("all")[F.col("shard")] + F.col("own")).alias("gain"))

    return _turns(state, facing, shards, placed, capacity, rounds)


def _least_held_go(state: DataFrame, links: DataFrame, fixed: DataFrame, rows: int, room: list[float]) -> DataFrame:
    """The nodes of ``state`` that stay in their shards' ``room``: those that most votes hold, by powers of two, come first."""
    met = state.join(heard(links, state.select("node", "shard").unionByName(fixed), len(room)), "node")
    ties = F.greatest(F.lit(1), F.col("all")[F.col("shard")] - F.col("own"))
    ranked = written(met.select("node", "size", "shard", F.floor(F.log2(ties.cast("double"))).cast("int").alias("ties")), "shards-held")
    sums = ranked.groupBy("shard", "ties").agg(F.sum("size").alias("bytes"))
    above = Window.partitionBy("shard").orderBy(F.desc("ties")).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", "ties", F.coalesce(F.sum("bytes").over(above), F.lit(0)).alias("base"))
    space = F.create_map(*[x for s, r in enumerate(room) for x in (F.lit(s), F.lit(r))])[F.col("shard")]
    # One row per shard and power of two.
    joined = _prefix(ranked, ["shard", "ties"], rows).join(F.broadcast(bases), ["shard", "ties"])
    return joined.where(F.col("base") + F.col("before") + F.col("size") <= space).select("node", "size", "shard")


def _turns(state: DataFrame, facing: Callable[[DataFrame], DataFrame], shards: int, placed: list[int], capacity: float, rounds: int) -> DataFrame:
    """Rounds of moves: ``facing`` adds to each node the shard it would move to and the gain.

    A round stores one table and brings sums to the driver, a row at most per two shards and power of two of the
    gain; the moves they allow are a column of that table, so nothing is joined for them.
    """
    columns, faced, stored, quiet = state.columns, None, None, 0
    for turn in range(rounds):
        if faced is None:
            former, faced = stored, written(facing(state), "shards-faced")
            if former is not None:
                given_up(former)
            state, stored = faced.select(*columns), faced
        towards = F.col("to") < F.col("shard") if turn % 2 == 0 else F.col("to") > F.col("shard")
        wish = (F.col("gain") > 0) & towards
        level = F.floor(F.log2(F.col("gain").cast("double"))).cast("int")
        sums = faced.groupBy("shard", F.when(wish, F.col("to")).alias("to"), F.when(wish, level).alias("level")).agg(F.sum("size").alias("bytes")).collect()
        if all(r["to"] is None for r in sums):
            quiet += 1
            if quiet == 2:
                break
            continue
        quiet = 0
        cuts = _admitted(sums, shards, placed, capacity)
        least, share = (F.array(*[F.lit(c[k]) for c in cuts])[F.col("to")] for k in (0, 1))
        draw = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        moves = wish & ((level > least) | ((level == least) & (draw < share)))
        state = faced.select(*[c for c in columns if c != "shard"], F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard"))
        faced = None
    return state


def _admitted(sums: list, shards: int, placed: list[int], capacity: float) -> list[tuple[int, float]]:
    """Per shard the class of gains that it takes in part, and that part; higher classes it takes whole."""
    loads, demand = list(placed), [{} for _ in range(shards)]
    for r in sums:
        loads[r["shard"]] += r["bytes"]
        if r["to"] is not None:
            demand[r["to"]][r["level"]] = demand[r["to"]].get(r["level"], 0) + r["bytes"]
    cuts = []
    for load, wanted in zip(loads, demand):
        room, cut = max(0.0, capacity - load), (64, 0.0)
        for level, size in sorted(wanted.items(), reverse=True):
            cut = (level, max(0.0, min(1.0, room / size)))
            room -= size
            if room <= 0:
                break
        cuts.append(cut)
    return cuts


def _prefix(nodes: DataFrame, groups: list[str], rows: int) -> DataFrame:
    """Adds ``before`` (bytes) and ``place`` (rows) ahead of each node of its group, in hash order."""
    buckets = max(1, min(MOST_BUCKETS, rows // ROWS_PER_BUCKET))
    keyed = nodes.withColumn("__bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))
    parts = keyed.groupBy(*groups, "__bucket").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(*groups, "__bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_base") for c in ("__bytes", "__rows")])
    inside = Window.partitionBy(*groups, "__bucket").orderBy("node")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = keyed.select("*", (F.sum("size").over(running) - F.col("size")).alias("__own"), (F.row_number().over(inside) - 1).alias("__at"))
    # One row per group and bucket: at most SHARDS * MOST_BUCKETS.
    joined = local.join(F.broadcast(bases), [*groups, "__bucket"])
    added = {"before": F.col("__own") + F.col("__bytes_base"), "place": (F.col("__at") + F.col("__rows_base")).cast("bigint")}
    return joined.withColumns(added).drop("__own", "__at", "__bucket", "__bytes_base", "__rows_base")


def _missing(loads: list[int], amount: int) -> list[float]:
    """What each shard takes of ``amount`` so that the least loaded come level first."""
    order, level = sorted(loads), 0.0
    for k in range(1, len(order) + 1):
        level = (amount + sum(order[:k])) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - x) for x in loads]


def fill(free: DataFrame, loads: list[int], rows: int) -> DataFrame:
    """Shards for the free nodes that bring ``loads`` level; ``free`` is read several times."""
    classes = sorted((r["c"], r["bytes"]) for r in free.groupBy(_class().alias("c")).agg(F.sum("size").alias("bytes")).collect())
    total, cuts, running = sum(b for _, b in classes), [], 0
    wanted = sorted(FILL_SHARES)
    for c, size in classes:
        running += size
        while wanted and running > wanted[0] * total:
            cuts.append(c)
            wanted.pop(0)
    edges = [*sorted(set(cuts), reverse=True), -1]
    loads, parts, above = list(loads), [], None
    for low in edges:
        part = free.where((_class() > low) if above is None else (_class() > low) & (_class() <= above))
        above = low
        amount = part.agg(F.sum("size")).first()[0]
        if amount is None:
            continue
        bounds, at = [], 0.0
        for width in _missing(loads, amount)[:-1]:
            at += width
            bounds.append(at)
        middle = F.col("before") + F.col("size") / 2
        shard = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= middle)) if bounds else F.lit(0)
        placed = written(_prefix(part, [], rows).select("node", "size", shard.cast("int").alias("shard")), "shards-filled")
        loads = [a + b for a, b in zip(loads, _loads(placed, len(loads)))]
        parts.append(placed)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _class() -> Column:
    return F.floor(F.log2(F.col("size").cast("double"))).cast("int")


def balanced_shards(nodes: DataFrame, edges: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, size, shard, slot): ``nodes`` (node unique, size > 0) and ``edges`` (a, b both ways) are written tables."""
    totals = nodes.agg(F.sum("size"), F.count(F.lit(1))).first()
    rows, fair = totals[1], (totals[0] or 0) / shards
    if rows == 0:
        return nodes.select("node", "size", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    ends = edges.select(F.col("a").alias("node")).distinct()
    state = propagate(nodes.join(ends, "node", "left_semi"), edges, shards, FULL * fair, rounds)
    loads = _loads(state, shards)
    keep = F.create_map(*[x for s in range(shards) for x in (F.lit(s), F.lit(min(1.0, FULL * fair / max(1, loads[s]))))])[F.col("shard")]
    kept = state.where(F.pmod(F.xxhash64("node", F.lit("keep")), F.lit(1 << 20)) / float(1 << 20) < keep)
    kept = written(kept, "shards-kept")
    free = written(nodes.select("node", "size").join(kept.select("node"), "node", "left_anti"), "shards-free")
    placed = kept if free.isEmpty() else kept.unionByName(fill(free, _loads(kept, shards), rows))
    return _prefix(placed, ["shard"], rows).select("node", "size", "shard", F.col("place").alias("slot"))


def place_big(groups: list[tuple[str, int]], shards: int, capacity: float) -> list[tuple[str, float, float, int]]:
    """(value, low, high, shard): the shares of each group's nodes and their shards, for few large groups."""
    room, out = [capacity] * shards, []
    for value, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        left, parts = float(size), []
        for s in sorted(range(shards), key=lambda s: (-room[s], s)):
            part = min(left, max(0.0, room[s]))
            if part > 0:
                parts.append([s, part])
                left -= part
            if left <= 0:
                break
        if left > 0:  # more than all shards hold: the rest is laid evenly over them
            found = {s: part for s, part in parts}
            parts = [[s, found.get(s, 0.0) + left / shards] for s in range(shards)]
        at = 0.0
        for k, (s, part) in enumerate(parts):
            high = 1.0 if k == len(parts) - 1 else at + part / size
            out.append((value, at, high, s))
            room[s] -= part
            at = high
    return out


def grouped_shards(nodes: DataFrame, value: str, shards: int = SHARDS, rounds: int = ROUNDS, links: str | None = None) -> DataFrame:
    """(node, size, shard, slot) with nodes of equal ``value`` in one shard where they fit; ``nodes`` is a written table.

    ``nodes`` has node (unique, bigint), size (> 0), ``value`` and, if named, ``links``: an array of the hashes
    of its pieces, alike for equal values. A null value is no group; null ``links`` are none.
    """
    totals = nodes.agg(F.sum("size"), F.count(F.lit(1))).first()
    rows, fair = totals[1], (totals[0] or 0) / shards
    if rows == 0:
        return nodes.select("node", "size", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    cell = F.pmod(F.xxhash64("node", F.lit("start")), F.lit(CELLS)).cast("int")
    keyed = nodes.select("node", "size", F.col(value).alias("value"), cell.alias("cell"))
    cells = written(keyed.where("value is not null").groupBy("value", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("node").alias("least")), "shards-cells")
    groups = cells.groupBy("value").agg(F.sum("n").alias("of"), F.sum("size").alias("bytes"), F.min("least").alias("unit")).where("of > 1")
    groups = written(groups, "shards-groups")
    # Each holds more than 1 / (BIG * shards) of all bytes, so there are fewer than BIG * shards.
    big = {r["value"]: r for r in groups.where(F.col("bytes") > fair / BIG).select("value", "bytes", "unit").collect()}
    spark = nodes.sparkSession
    kind = nodes.select(F.col(value).alias("v")).schema["v"].dataType.simpleString()
    parted = place_big([(v, r["bytes"]) for v, r in big.items()], shards, FULL * fair)
    shares = spark.createDataFrame(parted, f"v {kind}, low double, high double, shard int")
    fixed = spark.createDataFrame([(big[v]["unit"], s) for v, low, _, s in parted if low == 0.0], "node bigint, shard int")
    draw = F.pmod(F.xxhash64("node", F.lit("share")), F.lit(1 << 20)) / float(1 << 20)
    if big:
        sent = keyed.withColumn("draw", draw)
        hit = (sent["value"] == shares["v"]) & (sent["draw"] >= shares["low"]) & (sent["draw"] < shares["high"])
        spread = sent.join(F.broadcast(shares), hit, "left").select("node", "size", "value", "cell", F.col("shard").alias("big"))
    else:
        spread = keyed.withColumn("big", F.lit(None).cast("int"))
    small = groups.where(F.col("bytes") <= fair / BIG).select("value", "unit")
    parts = written(cells.join(small, "value").select("value", "unit", "cell", "n", "size"), "shards-parts")
    # A value's rows meet its unit by cell, so that a value of very many rows is CELLS keys.
    tagged = spread.join(parts.select("value", "cell", "unit"), ["value", "cell"], "left").select("node", "size", "cell", "big", "unit")
    tagged = written(tagged, "shards-tagged")
    first = tagged.where("big is not null").select("node", "size", F.col("big").alias("shard"))
    loads = _loads(first, shards)
    alone = tagged.where("big is null and unit is null").select("node", "size")
    units = written(alone.unionByName(parts.groupBy("unit").agg(F.sum("size").alias("size")).withColumnRenamed("unit", "node")), "shards-units")
    kept = None
    if links is not None:
        heads = units.select("node").unionByName(fixed.select("node"))
        held = nodes.select("node", links).join(heads, "node", "left_semi").select("node", F.explode(F.array_distinct(links)).alias("piece"))
        ties = bundled(written(held, "shards-pieces-held"))
        linked = units.join(own_votes(ties), "node")
        state = propagate_units(linked, ties, fixed, shards, loads, ROOMY * fair, rounds)
        kept = written(_least_held_go(state, ties, fixed, rows, [max(0.0, FULL * fair - x) for x in loads]), "shards-kept")
    free = units if kept is None else written(units.join(kept.select("node"), "node", "left_anti"), "shards-free")
    after = loads if kept is None else [a + b for a, b in zip(loads, _loads(kept, shards))]
    settled = [x for x in (kept, None if free.isEmpty() else fill(free, after, rows)) if x is not None]
    placed = settled[0] if len(settled) == 1 else settled[0].unionByName(settled[1])
    target = placed.select(F.col("node").alias("unit"), "shard")
    by_cell = parts.select("unit", "cell").join(target, "unit").unionByName(target.join(parts.select("unit"), "unit", "left_anti").select("unit", F.lit(-1).alias("cell"), "shard"))
    rest = tagged.where("big is null").select("node", "size", F.coalesce("unit", "node").alias("unit"), F.when(F.col("unit").isNull(), -1).otherwise(F.col("cell")).alias("cell"))
    out = first.unionByName(rest.join(by_cell, ["unit", "cell"]).select("node", "size", "shard"))
    return _prefix(written(out, "shards-placed"), ["shard"], rows).select("node", "size", "shard", F.col("place").alias("slot"))


def cut_links(links: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: pairs of nodes that share a piece (once a piece), those cut, and the same by votes; links from ``bundled``."""
    per = links.join(placed.select("node", "shard"), "node").groupBy("bundle", "n", "weight", "shard").agg(F.count(F.lit(1)).alias("c"))
    by = per.groupBy("bundle", "weight").agg(F.sum("c").alias("n"), F.sum(F.expr("c * (c - 1)")).alias("near"))
    pairs, cut = F.expr("n * (n - 1)"), F.expr("n * (n - 1) - near")
    return by.where("n > 1").agg(*[F.coalesce(F.sum(x * F.col("weight") / d), F.lit(0.0)).alias(name) for x, d, name in ((pairs, 2, "pairs"), (cut, 2, "cut_pairs"), (pairs, F.col("n") - 1, "votes"), (cut, F.col("n") - 1, "cut_votes"))])


def kept_together(nodes: DataFrame, value: str, placed: DataFrame) -> DataFrame:
    """One row: groups of equal ``value``, those in one shard, pairs of equal nodes and those in one shard."""
    held = nodes.where(F.col(value).isNotNull()).select("node", F.col(value).alias("value")).join(placed.select("node", "shard"), "node")
    per = held.groupBy("value", "shard").agg(F.count(F.lit(1)).alias("n"))
    by = per.groupBy("value").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.expr("n * (n - 1) div 2")).alias("near")).where("n > 1")
    return by.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("most") == F.col("n")).alias("whole"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.sum("near").alias("pairs_together"))


def cut_edges(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: edges (both ways counted once) and how many of them join two shards."""
    side = lambda c: placed.select(F.col("node").alias(c), F.col("shard").alias(f"{c}_shard"))
    both = edges.where("a < b").join(side("a"), "a").join(side("b"), "b")
    return both.agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("a_shard") != F.col("b_shard"), True)).alias("cut"))


def document_nodes(docs: DataFrame) -> DataFrame:
    """A written table: doc_id, text_crc32, node, size, digest of the text, links (its pieces)."""
    text = F.col("text").cast("string")
    nodes = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"), pieces(text).alias("links"),
    )
    return written(nodes.withColumn("node", F.monotonically_increasing_id()), "shard-nodes")


@query("op2_label_shards")
def op2_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = document_nodes(documents(spark, sf_dir))
    placed = grouped_shards(nodes.select("node", "size", "digest", "links"), "digest", links="links")
    rows = nodes.select("doc_id", "text_crc32", "node").join(placed, "node")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
