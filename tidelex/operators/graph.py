"""Graph operators: components, partition measures, Louvain communities."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Files, shared_dir


def cut(df: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The same rows without lineage, as a table in the folder that all executors share. A checkpoint would take over Spark's guess of its size; a join's guess is the product of its sides', so in
    loops of joins its digits double with each, until planning takes minutes. A table's size is known. gone: an earlier cut that nothing reads after this, which is removed."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if gone is not None:
        for f in {x.rpartition("/")[0] for x in gone.inputFiles()}:
            files = Files(f)
            files.fs.delete(files.of(f), True)
    return spark.read.schema(df.schema).parquet(at)


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition -> (node, least node that the partition's edges lead to)."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, z = root(u), root(v)
            if a != z:
                up[max(a, z)] = min(a, z)
    stars = [(x, r) for x in list(up) if (r := root(x)) != x]
    for i in range(0, len(stars), 10_000):
        part = stars[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], pa.string()) for k in (0, 1)], ["u", "v"])


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """links(u, v) -> (node, component): the least node of each connected component. Each partition first draws its own edges together into stars; then, round by
    round, the larger neighbours of a node go to the least node around it, and so do the others, until all edges form stars around
    least nodes. Edges don't grow in number, and paths about halve in a round. Loops and nulls have no part in it."""
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = cut(e.mapInArrow(_local_stars, "u string, v string").distinct())
    seen = None
    for _ in range(most_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = far.join(far.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = cut(near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), gone=e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def modularity(links: DataFrame, parts: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: modularity of the partition (node, component), nodes without a part being parts of their own."""
    of = lambda c: links.join(parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")), c, "left")
    e = of("u").select("u", "v", "weight", F.coalesce("part_u", "u").alias("pu"))
    e = e.join(parts.select(F.col("node").alias("v"), F.col("component").alias("part_v")), "v", "left").select("weight", "pu", F.coalesce("part_v", "v").alias("pv"))
    ends = e.select(F.explode(F.array("pu", "pv")).alias("part"), F.col("weight").alias("k"), F.lit(0).cast("long").alias("inner"))
    inner = e.where("pu = pv").select(F.col("pu").alias("part"), F.lit(0).cast("long").alias("k"), F.col("weight").alias("inner"))
    by = ends.unionAll(inner).groupBy("part").agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"))
    m = F.sum("k") / F.lit(2.0)
    return by.agg(F.round(F.sum("inner") / m - F.lit(gamma) * F.sum(F.col("k").cast("double") * F.col("k")) / (F.lit(4.0) * m * m), 6).alias("modularity"))


def edge_recall(links: DataFrame, parts: DataFrame) -> DataFrame:
    """By edge weight: edges, and the share whose ends are in one part."""
    p = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"p{c}"))
    e = links.join(p("u"), "u", "left").join(p("v"), "v", "left")
    return e.groupBy("weight").agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg(F.coalesce(F.col("pu") == F.col("pv"), F.lit(False)).cast("int")), 6).alias("recall"))


def density(links: DataFrame, parts: DataFrame) -> DataFrame:
    """Per part with both languages: nodes, edges inside, and edges over the possible pairs of its two languages' words."""
    n = parts.groupBy("component").agg(F.count_if(F.col("node").startswith("en:")).alias("n_en"), F.count_if(F.col("node").startswith("es:")).alias("n_es"))
    p = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"p{c}"))
    inner = links.join(p("u"), "u").join(p("v"), "v").where("pu = pv").groupBy(F.col("pu").alias("component")).agg(F.count(F.lit(1)).alias("inner_edges"))
    both = n.join(inner, "component", "left").withColumn("inner_edges", F.coalesce("inner_edges", F.lit(0).cast("long")))
    return both.where("n_en > 0 and n_es > 0").withColumn("density", F.round(F.col("inner_edges") / (F.col("n_en") * F.col("n_es")).cast("double"), 6))


def density_stats(links: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: mean, median and 10th percentile (linear between values) of the density of parts with both languages."""
    at = lambda q: F.round(F.percentile("density", F.lit(q)), 6)
    return density(links, parts).agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg("density"), 6).alias("mean"), at(0.5).alias("median"), at(0.1).alias("p10"))


def recall_of(held: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: held(u, v) whose ends are both placed, and the share of them in one part."""
    p = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"p{c}"))
    return held.join(p("u"), "u").join(p("v"), "v").agg(F.count(F.lit(1)).alias("evaluated"), F.round(F.avg((F.col("pu") == F.col("pv")).cast("int")), 6).alias("recall"))


def held_out(links: DataFrame, tenths: int = 1) -> DataFrame:
    """links with held: about that many tenths, by a hash of the ends."""
    h = F.conv(F.substring(F.sha1(F.concat_ws("|", "u", "v")), 1, 8), 16, 10).cast("long")
    return links.withColumn("held", h % 10 < tenths)


def _moves(near: list[dict[int, float]], degree: np.ndarray, own: np.ndarray, gamma: float, total: float, rng: np.random.Generator) -> bool:
    """Moves nodes, in place and in a random order, to the neighbouring community of the most gain, or to one of their own, until no move improves modularity;
    whether any did. Gains are in units of edge weight; what differs beyond nine places of the total weight's share counts as equal."""
    n = len(own)
    held = np.bincount(own, degree, n)
    size = np.bincount(own, minlength=n)
    empty = np.flatnonzero(size == 0).tolist()
    moved_ever = moved = False
    while True:
        moved = False
        for i in rng.permutation(n).tolist():
            here = own[i]
            held[here] -= degree[i]
            to: dict[int, float] = {here: 0.0}
            for j, w in near[i].items():
                to[own[j]] = to.get(own[j], 0.0) + w
            pull = gamma * degree[i] / (2 * total)
            gain = {c: k - pull * held[c] for c, k in to.items()}
            best = max(gain, key=lambda c: (round(gain[c], 9), c == here, -c))
            if round(gain[best], 9) < 0 and size[here] > 1:
                best = empty.pop()
            held[best] += degree[i]
            if best != here:
                own[i], moved, moved_ever = best, True, True
                size[here] -= 1
                size[best] += 1
                if not size[here]:
                    empty.append(int(here))
        if not moved:
            return moved_ever


def _adjacent(n: int, ends: np.ndarray, weight: np.ndarray) -> list[dict[int, float]]:
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in zip(ends.tolist(), weight.tolist(), strict=True):
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    return near


def louvain(n: int, ends: np.ndarray, weight: np.ndarray, gamma: float, total: float, seed: int) -> np.ndarray:
    """Communities of nodes 0..n-1, merged level by level and then refined node by node, again and again, until neither merging nor moving any single node
    improves modularity; total is the weight of all edges of the whole graph, so that components can be done one by one."""
    rng = np.random.default_rng(seed)
    near = _adjacent(n, ends, weight)
    degree = np.array([sum(x.values()) for x in near])
    label = np.arange(n)
    while True:
        moved = _moves(near, degree, label, gamma, total, rng)
        while True:
            names, at = np.unique(label, return_inverse=True)
            a, b = at[ends[:, 0]], at[ends[:, 1]]
            pair = np.c_[np.minimum(a, b), np.maximum(a, b)][a != b]
            if not len(pair) or len(names) == 1:
                break
            merged, place = np.unique(pair, axis=0, return_inverse=True)
            up = np.arange(len(names))
            if not _moves(_adjacent(len(names), merged, np.bincount(place.ravel(), weight[a != b])), np.bincount(at, degree), up, gamma, total, rng):
                break
            label, moved = up[at], True
        label = np.unique(label, return_inverse=True)[1]
        if not moved:
            return label


def improving(links: DataFrame, parts: DataFrame, gamma: float = 1.5) -> DataFrame:
    """(node, part, better, gain): nodes that a single move, to a neighbour's part or to one of their own (better is null), would improve modularity by, in units of
    edge weight. None, for a partition that is as good as single moves make it."""
    e = links.select("u", "v", F.col("weight").cast("double").alias("w")).where("u <> v")
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    total = F.lit(float(e.agg(F.sum("w")).first()[0] or 1.0))
    p = parts.select("node", F.col("component").alias("part"))
    degree = both.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")).join(p, "node")
    held = degree.groupBy("part").agg(F.sum("k").alias("held"))
    near = both.join(p.select(F.col("node").alias("v"), F.col("part").alias("to")), "v").groupBy(F.col("u").alias("node"), "to").agg(F.sum("w").alias("w"))
    alone = degree.select("node", F.lit(None).cast("string").alias("to"), F.lit(0.0).alias("w"))
    stay = degree.select("node", F.col("part").alias("to"), F.lit(0.0).alias("w"))
    options = near.unionByName(stay).groupBy("node", "to").agg(F.sum("w").alias("w")).unionByName(alone).join(degree, "node")
    options = options.join(held.withColumnRenamed("part", "to"), "to", "left")
    others = F.coalesce("held", F.lit(0.0)) - F.when(F.col("to") == F.col("part"), F.col("k")).otherwise(F.lit(0.0))
    gain = F.col("w") - F.lit(gamma) * F.col("k") * others / (F.lit(2.0) * total)
    g = options.withColumn("gain", gain)
    own = g.where(F.col("to") == F.col("part")).select("node", F.col("gain").alias("now"))
    best = g.groupBy("node").agg(F.max("gain").alias("gain"), F.max_by("to", "gain").alias("better"), F.first("part").alias("part"))
    return best.join(own, "node").where(F.col("gain") - F.col("now") > 1e-6).select("node", "part", "better", (F.col("gain") - F.col("now")).alias("gain"))


def communities(ends: np.ndarray, weight: np.ndarray, n: int, gamma: float, total: float, most: int, schedule: Callable[[float], float], seed: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, depth at which it was made, whether it is above most nodes all the same) of each node. Louvain parts above most nodes are divided
    again at the schedule's next resolution, on themselves alone, until that has no effect."""
    label = louvain(n, ends, weight, gamma, float(weight.sum()) if depth else total, seed)
    sizes = np.bincount(label)
    deep = np.full(n, depth)
    if depth and len(sizes) == 1:
        return label, deep, np.full(n, n > most)
    out, stuck, free = label.copy(), np.zeros(n, bool), len(sizes)
    for c in np.flatnonzero(sizes > most).tolist():
        mine = np.flatnonzero(label == c)
        inner = (label[ends] == c).all(axis=1)
        place = np.full(n, -1)
        place[mine] = np.arange(len(mine))
        again, deep[mine], stuck[mine] = communities(place[ends[inner]], weight[inner], len(mine), schedule(gamma), total, most, schedule, seed, depth + 1)
        out[mine] = again + free
        free += int(again.max()) + 1
    return np.unique(out, return_inverse=True)[1], deep, stuck


def linear(step: float) -> Callable[[float], float]:
    return lambda gamma: gamma + step


def exponential(factor: float) -> Callable[[float], float]:
    return lambda gamma: gamma * factor


PARTS = "node string, component string, part string, depth long, stuck boolean"


def louvain_parts(
    links: DataFrame, parts: DataFrame, gamma: float = 1.5, most: int = 20, schedule: Callable[[float], float] = linear(0.5), seed: int = 42, bundle_edges: int = 50_000, large_edges: int = 2_000_000
) -> DataFrame:
    """(node, component, part, depth, stuck): communities within each connected component. Components are done in bundles of about bundle_edges edges, a
    task each. One above large_edges is first cut into communities by rounds of joins over all executors, and each of these is
    a bundle's graph of its own from then on."""
    n, total = links.agg(F.count(F.lit(1)), F.sum("weight")).first()
    total = float(total or 1.0)
    e = links.join(parts.select(F.col("node").alias("u"), "component"), "u").select("u", "v", F.col("weight").cast("double").alias("weight"), "component")
    large = e.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large_edges).select("component") if n > large_edges else None
    out = None
    if large is not None and not large.isEmpty():
        big = cut(e.join(large, "component", "left_semi"))
        e = e.join(large, "component", "left_anti")
        moved = cut(moved_parts(big.select("u", "v", "weight"), gamma, total))
        own = big.select("component", F.explode(F.array("u", "v")).alias("node")).distinct().join(moved, "node")
        size = Window.partitionBy("part")
        own = own.withColumn("n", F.count(F.lit(1)).over(size))
        out = own.where(F.col("n") <= most).select("node", "component", F.min("node").over(size).alias("part"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("stuck"))
        p = lambda c: own.where(F.col("n") > most).select(F.col("node").alias(c), F.col("part").alias(f"p{c}"))
        inner = big.join(p("u"), "u").join(p("v"), "v").where("pu = pv").select("u", "v", "weight", "component", F.col("pu").alias("own"))
        out = out.unionByName(_in_bundles(inner, n, bundle_edges, gamma, total, most, schedule, seed, 1))
    rest = _in_bundles(e.withColumn("own", F.lit("")), n, bundle_edges, gamma, total, most, schedule, seed, 0)
    return rest if out is None else out.unionByName(rest)


def _in_bundles(e: DataFrame, n: int, bundle_edges: int, gamma: float, total: float, most: int, schedule: Callable[[float], float], seed: int, depth: int) -> DataFrame:
    """e(u, v, weight, component, own): graphs by component and own. At depth 0 they go together, as moves don't reach from one
    component to another but for the total weight; deeper, each has its own total."""
    bundles = max(1, -(-n // bundle_edges))

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, g in [(0, df)] if depth == 0 else df.groupby(["component", "own"]):
            g = g.sort_values(["u", "v"])
            names, at = np.unique(np.r_[g.u.to_numpy(str), g.v.to_numpy(str)], return_inverse=True)
            ends = at.reshape(2, -1).T
            got, deep, stuck = communities(ends, g.weight.to_numpy(float), len(names), gamma if depth == 0 else schedule(gamma), total, most, schedule, seed, depth)
            order = np.lexsort((names, got))
            first = np.r_[True, got[order][1:] != got[order][:-1]]
            low = names[order][first]
            home = np.empty(len(names), object)
            home[ends[:, 0]], home[ends[:, 1]] = g.component.to_numpy(), g.component.to_numpy()
            rows.append(pd.DataFrame({"node": names, "component": home, "part": low[got], "depth": deep, "stuck": stuck}))
        return pd.concat(rows)

    return e.groupBy(F.pmod(F.xxhash64("component", "own"), F.lit(bundles))).applyInPandas(run, PARTS)


def moved_parts(links: DataFrame, gamma: float, total: float, rounds: int = 12, levels: int = 6) -> DataFrame:
    """links(u, v, weight) -> (node, part): Louvain by joins, for graphs that don't fit a task. In a round half of the nodes, by a hash, move to the community
    of the most gain, all at once; when two rounds change nothing, communities become the nodes of the next level. Warns when rounds or levels run out."""
    place = cut(links.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("part", F.col("node")))
    e = cut(links.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("weight").alias("w")))
    for _ in range(levels):
        both = e.where("u <> v").unionAll(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
        degree = e.select(F.explode(F.array("u", "v")).alias("u"), "w").groupBy("u").agg(F.sum("w").alias("k"))
        own = cut(degree.withColumn("c", F.col("u")))
        quiet, moved_ever = 0, False
        for r in range(rounds):
            held = own.groupBy("c").agg(F.sum("k").alias("held"))
            near = both.join(own.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("to"))
            near = near.unionAll(own.select("u", "c", F.lit(0.0).alias("to"))).groupBy("u", "c").agg(F.sum("to").alias("to"))
            near = near.join(own.select("u", "k", F.col("c").alias("now")), "u").join(held, "c")
            left = F.col("held") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(F.lit(0.0))
            gain = F.round(F.col("to") / F.lit(total) - F.lit(gamma) * F.col("k") * left / F.lit(2 * total * total), 12)
            best = near.withColumn("gain", gain).groupBy("u").agg(F.max_by("c", F.struct("gain", F.col("c") == F.col("now"), "c")).alias("best"), F.first("k").alias("k"), F.first("now").alias("now"))
            turn = F.pmod(F.xxhash64("u", F.lit(r // 2)), F.lit(2)) == r % 2
            nxt = cut(best.select("u", "k", F.when(turn, F.col("best")).otherwise(F.col("now")).alias("c"), "now"), gone=own)
            moved = not nxt.where("c <> now").isEmpty()
            own = nxt.select("u", "k", "c")
            moved_ever |= moved
            quiet = 0 if moved else quiet + 1
            if quiet == 2:
                break
        else:
            warnings.warn(f"communities haven't settled in {rounds} rounds of a level", stacklevel=2)
        if not moved_ever:
            return place
        place = cut(place.join(own.select(F.col("u").alias("part"), "c"), "part").select("node", F.col("c").alias("part")))
        p = lambda c: own.select(F.col("u").alias(c), F.col("c").alias(f"c{c}"))
        e = cut(e.join(p("u"), "u").join(p("v"), "v").groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w")))
    warnings.warn(f"communities haven't settled in {levels} levels", stacklevel=2)
    return place


def compare(links: DataFrame, named: dict[str, DataFrame]) -> DataFrame:
    """Partitions (node, component) by name, side by side: nodes, modularity, recall of all edges, and how many of the others each beats in
    both, ties or loses to."""
    out = None
    for name, parts in named.items():
        n = parts.agg(F.count(F.lit(1)).alias("nodes"))
        p = lambda c, parts=parts: parts.select(F.col("node").alias(c), F.col("component").alias(f"p{c}"))
        same = F.coalesce(F.col("pu") == F.col("pv"), F.lit(False)).cast("int")
        r = links.join(p("u"), "u", "left").join(p("v"), "v", "left").agg(F.round(F.avg(same), 6).alias("recall"))
        row = _in_a_row(name, n, modularity(links, parts), r)
        out = row if out is None else out.unionByName(row)
    return tally(out.select("name", "nodes", "modularity", "recall"), "modularity")


def probe(links: DataFrame, words: DataFrame, named: dict[str, DataFrame]) -> DataFrame:
    """words(node), a stated few -> (name, node, degree, size, inside): for each partition (node, component) by name, how large a word's part is and how many of its translations are in
    it; words without a part have neither."""
    some = F.broadcast(words.select("node"))
    near = links.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(links.select(F.col("v").alias("node"), F.col("u").alias("other"))).join(some, "node").distinct()
    degree = near.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    out = None
    for name, parts in named.items():
        p = parts.select("node", "component")
        own = p.join(some, "node")
        size = p.join(own.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        inner = near.join(own, "node").join(p.toDF("other", "its"), "other").where("component = its").groupBy("node").agg(F.count(F.lit(1)).alias("inside"))
        row = degree.join(own.join(size, "component"), "node", "left").join(inner, "node", "left").select(F.lit(name).alias("name"), "node", "degree", "size", F.when(F.col("size").isNotNull(), F.coalesce("inside", F.lit(0).cast("long"))).alias("inside"))
        out = row if out is None else out.unionByName(row)
    return out


def _in_a_row(name: str, *ones: DataFrame) -> DataFrame:
    """Tables of one row each, side by side under a name."""
    out, *more = (x.withColumn("name", F.lit(name)) for x in ones)
    for x in more:
        out = out.join(x, "name")
    return out


def side_by_side(*ones: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    return _in_a_row("", *ones).drop("name")


def tally(rows: DataFrame, by: str) -> DataFrame:
    """rows(name, ...), a few, with wins, ties and losses of each against all others by a column."""
    a, b = rows.alias("a"), rows.select(F.col("name").alias("other"), F.col(by).alias("its")).alias("b")
    each = a.join(b, F.col("a.name") != F.col("b.other"), "left")
    n = lambda c: F.count_if(c)
    return each.groupBy(*[F.col(f"a.{c}") for c in rows.columns]).agg(n(F.col(by) > F.col("its")).alias("wins"), n(F.col(by) == F.col("its")).alias("ties"), n(F.col(by) < F.col("its")).alias("losses"))


def schedules(links: DataFrame, parts: DataFrame, named: dict[str, Callable[[float], float]], most: int = 20, gamma: float = 1.5) -> DataFrame:
    """Schedules of resolution by name: parts, nodes by the depth their part was made at (as depth=nodes), nodes in parts that stayed above most,
    modularity, and the tally by it."""
    out = None
    for name, schedule in named.items():
        found = cut(louvain_parts(links, parts, gamma, most, schedule))
        depth = found.groupBy("depth").agg(F.count(F.lit(1)).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "k"))), lambda x: F.concat_ws("=", x["depth"].cast("string"), x["k"].cast("string"))), " ").alias("depths"))
        n = found.agg(F.count_distinct("part").alias("parts"), F.count_if("stuck").alias("undivided"))
        m = modularity(links, found.select("node", F.col("part").alias("component")))
        row = _in_a_row(name, n, depth, m)
        out = row if out is None else out.unionByName(row)
    return tally(out.select("name", "parts", "depths", "undivided", "modularity"), "modularity")
