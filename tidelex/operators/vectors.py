"""Vector operators: distances, mining grids, losses, pooling, and diagnostics of vector sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine_distance, dot, norm, relu, unit
from .graph import cut
from .search import blocks_of


def pairs(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """rows(concept_id, id, lang, x) of capped concepts -> pairs within a concept with their rounded cosine distance: a < b, or
    all ordered pairs a <> b."""
    own = lambda k: rows.select("concept_id", F.col("id").alias(k), F.col("lang").alias(f"lang_{k}"), F.col("x").alias(f"x{k}"), norm(F.col("x")).alias(f"n{k}"))
    far = F.lit(1.0) - dot(F.col("xa"), F.col("xb")) / (F.col("na") * F.col("nb") + F.lit(1e-8))
    j = own("a").join(own("b"), "concept_id").where("a < b").select("concept_id", "a", "b", "lang_a", "lang_b", F.round(far, 6).alias("dist"))
    if not ordered:
        return j
    ways = F.array(F.struct("a", "b", "lang_a", "lang_b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("lang_b").alias("lang_a"), F.col("lang_a").alias("lang_b")))
    return j.select("concept_id", "dist", F.inline(ways)).select("concept_id", "a", "b", "lang_a", "lang_b", "dist")


def dynamic_margin(dist: DataFrame, floor: float, scale: float) -> DataFrame:
    """Per concept: the larger of floor and scale times the population deviation of its distances (floor under 3 rows)."""
    g = dist.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.stddev_pop("dist").alias("sd"))
    return g.select("concept_id", "n_pairs", F.round(F.when((F.lit(scale) > 0) & (F.col("n_pairs") >= 3), F.greatest(F.lit(floor), F.lit(scale) * F.col("sd"))).otherwise(F.lit(floor)), 6).alias("margin"))


#: Distances in millionths; what isn't a number comes after all that are, missing ones after these, and an anchor's own rows last.
_NAN, _NULL, _SELF = 1 << 30, 1 << 31, 1 << 32
_PLACE = 1 << 20


def _matrix(x: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays as a matrix, short ones filled up with zeros; their widths, -1 where one or an element is missing; and their lengths."""
    x = pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type)
    width = pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = x.flatten()
    out = np.zeros((len(width), max(int(width.max(initial=0)), 0)))
    inside = np.arange(out.shape[1]) < width[:, None]
    out[inside] = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        gone = np.zeros(out.shape, bool)
        gone[inside] = pc.is_null(flat).to_numpy(zero_copy_only=False)
        width[gone.any(axis=1)] = -1
    return out, width, np.sqrt(np.einsum("ij,ij->i", out, out))


def _far(a: tuple, ida: np.ndarray, b: tuple, idb: np.ndarray) -> np.ndarray:
    """Keys of the distances of rows a to rows b in the order of their ids: the distance's millionths before the place of b."""
    (xa, wa, na), (xb, wb, nb) = a, b
    wide = max(xa.shape[1], xb.shape[1])
    xa, xb = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (xa, xb))
    with np.errstate(all="ignore"):
        d = np.rint((1.0 - (xa @ xb.T) / (na[:, None] * nb + 1e-8)) * 1e6)
    bad = ~np.isfinite(d)
    d[bad] = _NAN
    key = d.astype(np.int64)
    key[(wa[:, None] != wb) | (wa[:, None] < 0)] = _NULL
    key[ida[:, None] == idb] = _SELF
    return key * _PLACE + np.arange(len(idb))


def _sides(left: pa.Table, right: pa.Table, lang: str, step: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """For each language of right, and step rows of left at a time (of that language by the column lang, or all): the language, the places in left, keys, and the ids that keys end with."""
    a, ida = _matrix(left["x"]), left["id"].to_numpy()
    b, idb = _matrix(right["y"]), right["b"].to_numpy()
    of, want = np.array(right["lang_b"].to_pylist(), object), np.array(left[lang].to_pylist(), object) if lang else None
    for name in sorted(set(of)):
        mine = np.flatnonzero(of == name)
        mine = mine[np.argsort(idb[mine], kind="stable")]
        rows = np.arange(len(ida)) if want is None else np.flatnonzero(want == name)
        for i in range(0, len(rows), step):
            at = rows[i : i + step]
            yield name, at, _far(tuple(v[at] for v in a), ida[at], tuple(v[mine] for v in b), idb[mine]), idb[mine]


def mining_grid(rows: DataFrame, margin: float, most: int = 20, anchors: int = 2048, others: int = 8192, step: int = 256) -> DataFrame:
    """rows(concept_id, id, lang, x) -> for each anchor and language of its neighbours, and each of the k = min(most, max(1, m // 3)) nearest of its m >= 3 neighbours as the positive: the first
    neighbour from rank k on that is farther by margin, as the negative. An id has one language.

    Every pair of a concept's rows is looked at, but none is a row: blocks of about anchors rows meet blocks of about others, a task each, and keep an anchor's k + 1 nearest. Of these the last is the
    negative of positives that it is far enough from; for the rest blocks meet once more and give the nearest neighbour beyond each positive's distance and margin."""
    rows = rows.where("concept_id is not null and id is not null and lang is not null").select("concept_id", "id", "lang", "x")
    n = rows.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    dealt = rows.join(n.select("concept_id", F.ceil(F.col("n") / F.lit(float(anchors))).alias("n_a"), F.ceil(F.col("n") / F.lit(float(others))).alias("n_b")), "concept_id")
    part = lambda seed, k: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(k))
    all_of = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    key = ["concept_id", "i", "j"]
    renamed = (F.col(c).alias(k) for c, k in (("concept_id", "own"), ("id", "b"), ("lang", "lang_b"), ("x", "y")))
    right = dealt.select(*renamed, part(2, "n_b").alias("j"), all_of("n_a").alias("i")).groupBy("own", "i", "j")
    left = dealt.select("concept_id", part(1, "n_a").alias("i"), all_of("n_b").alias("j"), "id", "lang", "x")

    def nearest_of(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for name, at, keys, ids in _sides(left, right, "", step) if len(left) and len(right) else ():
            m = (keys < _SELF * _PLACE).sum(axis=1)
            few = min(most, keys.shape[1] - 1)
            top = np.sort(np.partition(keys, few, axis=1)[:, : few + 1], axis=1)
            has = top < _SELF * _PLACE
            near = pa.StructArray.from_arrays([pa.array((top // _PLACE)[has]), pa.array(ids[(top % _PLACE)[has]])], ["d", "b"])
            ends = pa.array(np.r_[0, np.cumsum(has.sum(axis=1))].astype(np.int32))
            own = left.take(pa.array(at)).select(["concept_id", "id", "lang"])
            out.append(pa.table([*(c.combine_chunks() for c in own.columns), pa.array([name] * len(at), pa.string()), pa.array(m), pa.ListArray.from_arrays(ends, near)], ["concept_id", "a", "lang_a", "lang_b", "m", "near"]))
        return pa.concat_tables(out) if out else _NEAR.empty_table()

    near = left.groupBy(*key).cogroup(right).applyInArrow(nearest_of, "concept_id string, a long, lang_a string, lang_b string, m long, near array<struct<d: long, b: long>>")
    near = near.groupBy("concept_id", "a", "lang_a", "lang_b").agg(F.sum("m").alias("m"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most + 1).alias("near"))
    k = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("m") / F.lit(3.0)))).cast("int")
    near = cut(near.where("m >= 3").select("concept_id", "a", "lang_a", "lang_b", F.slice("near", F.lit(1), k).alias("near"), F.get("near", k).alias("last")))  # read twice
    beyond = lambda p: F.when(p["d"] < _NAN, p["d"] + F.round(F.lit(margin * 1e6)).cast("long")).otherwise(p["d"])
    each = near.select("concept_id", "a", "lang_a", "lang_b", "last", F.posexplode("near").alias("pos_rank", "p")).where(F.col("p.d") < _NULL).withColumn("least", beyond(F.col("p")))
    enough = (F.col("last.d") >= F.col("least")) & (F.col("last.d") < _NULL)

    wants = near.select("concept_id", F.col("a").alias("id"), "lang_b", F.filter(F.array_distinct(F.transform(F.filter("near", lambda p: p["d"] < _NULL), beyond)), lambda x: x > F.col("last.d")).alias("wants")).where(F.size("wants") > 0)
    asking = left.drop("lang").join(wants, ["concept_id", "id"])

    def first_beyond(left: pa.Table, right: pa.Table) -> pa.Table:
        out, asked = [], left["wants"].to_pylist() if len(left) else []
        for name, at, keys, ids in _sides(left, right, "lang_b", step) if len(left) and len(right) else ():
            keys.sort(axis=1)
            least = [np.array(asked[r], np.int64) for r in at]
            found = [np.searchsorted(x, w * _PLACE) for x, w in zip(keys, least, strict=True)]
            r, c, w = np.repeat(np.arange(len(at)), [len(f) for f in found]), np.concatenate(found), np.concatenate(least)
            inside = c < keys.shape[1]
            r, w, got = r[inside], w[inside], keys[r[inside], c[inside]]
            good = got < _NULL * _PLACE
            own = left.take(pa.array(at[r[good]])).select(["concept_id", "id", "lang_b"])
            out.append(pa.table([*(x.combine_chunks() for x in own.columns), pa.array(w[good]), pa.array(got[good] // _PLACE), pa.array(ids[got[good] % _PLACE])], ["concept_id", "a", "lang_b", "least", "d", "b"]))
        return pa.concat_tables(out) if out else _BEYOND.empty_table()

    found = asking.groupBy(*key).cogroup(right).applyInArrow(first_beyond, "concept_id string, a long, lang_b string, least long, d long, b long")
    found = found.groupBy("concept_id", "a", "lang_b", "least").agg(F.min(F.struct("d", "b")).alias("n"))
    both = each.withColumn("near_n", F.when(enough, F.col("last"))).join(found, ["concept_id", "a", "lang_b", "least"], "left").withColumn("n", F.coalesce("near_n", "n")).where("n is not null")
    gap = F.when((F.col("n.d") < _NAN) & (F.col("p.d") < _NAN), F.round((F.col("n.d") - F.col("p.d")) / F.lit(1e6), 6)).otherwise(F.lit(float("nan")))
    return both.select("concept_id", "a", "lang_a", "lang_b", F.col("pos_rank").cast("long").alias("pos_rank"), F.col("p.b").alias("pos"), F.col("n.b").alias("neg"), gap.alias("gap"))


_NEAR = pa.schema([("concept_id", pa.string()), ("a", pa.int64()), ("lang_a", pa.string()), ("lang_b", pa.string()), ("m", pa.int64()), ("near", pa.list_(pa.struct([("d", pa.int64()), ("b", pa.int64())])))])
_BEYOND = pa.schema([("concept_id", pa.string()), ("a", pa.int64()), ("lang_b", pa.string()), ("least", pa.int64()), ("d", pa.int64()), ("b", pa.int64())])


def pair_grid(dist: DataFrame, floor: float) -> DataFrame:
    """For each anchor and pair of others: the closer one as the positive, if the distances differ by floor or more."""
    p, q = dist.select("concept_id", "a", F.col("b").alias("p"), F.col("dist").alias("dp")), dist.select("concept_id", "a", F.col("b").alias("q"), F.col("dist").alias("dq"))
    j = p.join(q, ["concept_id", "a"]).where("p < q").withColumn("gap", F.round(F.abs(F.col("dp") - F.col("dq")), 6)).where(F.col("gap") >= floor)
    near = F.col("dp") <= F.col("dq")
    return j.select("concept_id", "a", F.when(near, F.col("p")).otherwise(F.col("q")).alias("pos"), F.when(near, F.col("q")).otherwise(F.col("p")).alias("neg"), "gap")


def five_point_grid(grid: DataFrame) -> DataFrame:
    """A same-language triplet (nearest positive) with a cross-language one of the same anchor where there is one."""
    first = grid.where("pos_rank = 0")
    same = first.where("lang_a = lang_b").select("concept_id", "a", F.col("pos").alias("sl_pos"), F.col("neg").alias("sl_neg"), F.col("gap").alias("margin_sl"))
    cross = first.where("lang_a <> lang_b").select("concept_id", "a", F.col("pos").alias("x_pos"), F.col("neg").alias("x_neg"), F.col("gap").alias("x_gap"))
    j = same.join(cross, ["concept_id", "a"], "left")
    return j.select("concept_id", "a", "sl_pos", "sl_neg", F.coalesce("x_pos", "a").alias("xl_pos"), F.coalesce("x_neg", "a").alias("xl_neg"), "margin_sl", F.coalesce("x_gap", F.lit(0.0)).alias("margin_xl"), F.col("x_pos").isNotNull().alias("has_xl"))


def triplet_loss(samples: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: mean over five-point samples of the hinge of both triplets' cosine distances."""
    s = samples
    for role in ("a", "sl_pos", "sl_neg", "xl_pos", "xl_neg"):
        s = s.join(vectors.select(F.col("id").alias(role), F.col("x").alias(f"v_{role}")), role)
    d = lambda r: cosine_distance(F.col("v_a"), F.col(f"v_{r}"))
    loss = relu(d("sl_pos") - d("sl_neg") + F.col("margin_sl")) + F.col("has_xl").cast("double") * relu(d("xl_pos") - d("xl_neg") + F.col("margin_xl"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("loss"))


def pooled(token_rows: DataFrame, spans: DataFrame) -> DataFrame:
    """token_rows(id, s, e, x) and spans(id, occ, start, end) -> (id, x): the mean of the tokens that overlap an occurrence, to unit
    length, then the mean of the occurrences, to unit length. Tokens with empty ranges are special and never count."""
    hit = token_rows.where("e > s").join(spans, "id").where("s < end and e > start")
    dims = hit.select("id", "occ", F.posexplode("x").alias("i", "v")).groupBy("id", "occ", "i").agg(F.avg("v").alias("v"))
    occ = dims.groupBy("id", "occ").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).select("id", unit(F.col("p")["v"]).alias("x"))
    mean = occ.select("id", F.posexplode("x").alias("i", "v")).groupBy("id", "i").agg(F.avg("v").alias("v"))
    return mean.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).select("id", unit(F.col("p")["v"]).alias("x"))


def mean_vector_stats(rows: DataFrame) -> DataFrame:
    """(concept_id, n, total): vectors of unit length summed up by place; means of cosines follow without pairs."""
    n = rows.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    dims = rows.select("concept_id", F.posexplode(unit(F.col("x"))).alias("i", "v")).groupBy("concept_id", "i").agg(F.sum("v").alias("v"))
    return dims.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).select("concept_id", F.col("p")["v"].alias("total")).join(n, "concept_id")


def intra_inter(rows: DataFrame) -> DataFrame:
    """Per concept: mean cosine of its pairs and to all other rows. As sums of unit vectors: no row meets another."""
    s = mean_vector_stats(rows)
    dims = s.select(F.posexplode("total").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    everything = dims.agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).select(F.col("p")["v"].alias("all"), F.lit(1).alias("one"))
    whole = s.agg(F.sum("n").alias("n_all")).select("n_all", F.lit(1).alias("one")).join(everything, "one")
    j = s.withColumn("one", F.lit(1)).join(whole, "one").drop("one")
    own, n = dot(F.col("total"), F.col("total")), F.col("n")
    return j.select("concept_id", "n", F.round((own - n) / (n * (n - 1)).cast("double"), 6).alias("intra"), F.round((dot(F.col("total"), F.col("all")) - own) / (n * (F.col("n_all") - n)).cast("double"), 6).alias("inter"))


def rejection(grid: DataFrame, margins: tuple[float, ...]) -> DataFrame:
    """grid(gap): by margin, the share of triplets whose positive distance, plus margin, is not below the negative's."""
    each = grid.withColumn("margin", F.explode(F.array(*[F.lit(m) for m in margins])))
    return each.groupBy("margin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.round(F.col("margin") - F.col("gap"), 6) >= 0).cast("int")), 6).alias("rejected"))


def nearest(probes: DataFrame, rows: DataFrame, block: int = 8192, step: int = 2048) -> DataFrame:
    """probes(id, concept_id, x) and rows(id, concept_id, x) -> (a, ca, b, cb, cosine): the nearest row of each probe, by the cosine to six places and then the
    least id. The probes are a stated set, compared with all rows: a matrix product of each block of them with each batch."""
    out = None
    for part in blocks_of(probes.select("id", "concept_id", "x"), lambda r: 1, block):
        x = np.array([r["x"] for r in part], float)
        shared = rows.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in part]), [r["concept_id"] for r in part], x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a, ca, u = shared.value
            best, who, what = np.full(len(a), -np.inf), np.zeros(len(a), np.int64), np.full(len(a), None, object)
            for b in batches:
                ids, names = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), object)
                v = np.array(b.column(2).to_pylist(), float).reshape(len(ids), -1)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
                order = np.argsort(ids, kind="stable")  # the first of equal cosines is that of the least id
                for i in range(0, len(order), step):
                    at = order[i : i + step]
                    cos = np.round(u @ v[at].T, 6)
                    j = cos.argmax(axis=1)
                    c, w = cos[np.arange(len(a)), j], ids[at][j]
                    new = (c > best) | ((c == best) & (w < who))
                    best[new], who[new], what[new] = c[new], w[new], names[at][j][new]
            got = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(a[got]), pa.array([x for x, g in zip(ca, got, strict=True) if g], pa.string()), pa.array(who[got]), pa.array(what[got].tolist(), pa.string()), pa.array(best[got])], ["a", "ca", "b", "cb", "cosine"])

        found = rows.select("id", "concept_id", "x").mapInArrow(run, "a long, ca string, b long, cb string, cosine double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "a long, ca string, b long, cb string, cosine double")
    return out.groupBy("a", "ca").agg(F.min(F.struct((-F.col("cosine")).alias("s"), "b", "cb")).alias("m")).select("a", "ca", "m.b", "m.cb", (-F.col("m.s")).alias("cosine"))


def cross_top1(rows: DataFrame, probes: Column) -> DataFrame:
    """One row: probes, and the share of probe rows whose nearest row of the other language has the same concept."""
    best = nearest(rows.where((F.col("lang") == "en") & probes), rows.where(F.col("lang") == "es"))
    return best.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("ca") == F.col("cb")).cast("int")), 6).alias("same_concept"))


def norm_stats(rows: DataFrame) -> DataFrame:
    n = rows.select("concept_id", norm(F.col("x")).alias("v"))
    at = lambda p: F.round(F.percentile("v", F.lit(p)), 6)
    return n.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))


def silhouette(rows: DataFrame) -> DataFrame:
    """rows(concept_id, id, cluster, x) of capped concepts -> mean exact Euclidean silhouette per concept."""
    a = rows.select("concept_id", F.col("id").alias("a"), F.col("cluster").alias("ca"), F.col("x").alias("xa"))
    b = rows.select("concept_id", F.col("id").alias("b"), F.col("cluster").alias("cb"), F.col("x").alias("xb"))
    d = F.sqrt(F.aggregate(F.zip_with(F.col("xa").cast("array<double>"), F.col("xb").cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    m = a.join(b, "concept_id").where("a <> b").withColumn("d", d).groupBy("concept_id", "a", "ca", "cb").agg(F.avg("d").alias("d"))
    s = m.groupBy("concept_id", "a").agg(F.min(F.when(F.col("ca") == F.col("cb"), F.col("d"))).alias("own"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("d"))).alias("other"))
    value = F.when(F.col("own").isNull() | F.col("other").isNull(), F.lit(0.0)).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return s.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("silhouette"))


def similarity_stats(dist: DataFrame) -> DataFrame:
    """Per concept, within and across languages: number, mean, deviation and percentiles (linear between values) of the similarities."""
    s = dist.withColumns({"s": F.lit(1.0) - F.col("dist"), "same_lang": F.col("lang_a") == F.col("lang_b")})
    at = lambda q: F.round(F.percentile("s", F.lit(q)), 6)
    return s.groupBy("concept_id", "same_lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_pop("s"), 6).alias("std"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))


def bucket_matrix(rows: DataFrame, bucket: str = "concept_id") -> DataFrame:
    """(bucket_a, bucket_b, n_pairs, mean): mean cosine within each bucket and between each two, from sums of unit vectors: no row meets another.
    Buckets are few: all pairs of them are given."""
    s = mean_vector_stats(rows.withColumn("concept_id", F.col(bucket).cast("string")))
    a, b = (s.select(F.col("concept_id").alias(f"bucket_{k}"), F.col("total").alias(f"t{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    j = a.join(b, F.col("bucket_a") <= F.col("bucket_b"))
    d, same = dot(F.col("ta"), F.col("tb")), F.col("bucket_a") == F.col("bucket_b")
    n = F.when(same, F.col("na") * (F.col("na") - 1) / F.lit(2.0)).otherwise(F.col("na") * F.col("nb")).cast("long")
    total = F.when(same, (d - F.col("na")) / 2).otherwise(d)
    return j.withColumn("n_pairs", n).where("n_pairs > 0").select("bucket_a", "bucket_b", "n_pairs", F.round(total / F.col("n_pairs").cast("double"), 6).alias("mean"))


def bucket_gap(matrix: DataFrame) -> DataFrame:
    """One row: the least mean within a bucket, the largest between two, and the gap."""
    low, high = F.min(F.when(F.col("bucket_a") == F.col("bucket_b"), F.col("mean"))), F.max(F.when(F.col("bucket_a") != F.col("bucket_b"), F.col("mean")))
    return matrix.agg(F.round(low, 6).alias("least_intra"), F.round(high, 6).alias("most_cross"), F.round(low - high, 6).alias("gap"))


def cross_gap(rows: DataFrame) -> DataFrame:
    """Per concept: mean cosine of its English rows to its Spanish ones, and to those of other concepts."""
    en, es = (mean_vector_stats(rows.where(F.col("lang") == x)) for x in ("en", "es"))
    every = es.select(F.posexplode("total").alias("i", "v"), "n").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"), F.max("n").alias("n_all"))
    whole = every.select(F.col("p")["v"].alias("all"), "n_all")
    one = lambda df: df.withColumn("one", F.lit(1))
    j = one(en).join(one(whole), "one").drop("one").join(es.select("concept_id", F.col("total").alias("own"), F.col("n").alias("n_own")), "concept_id", "left")
    own, n_own = F.coalesce(dot(F.col("total"), F.col("own")), F.lit(0.0)), F.coalesce("n_own", F.lit(0))
    mean = lambda x, n: F.when(n > 0, F.round(x / n.cast("double"), 6))
    return j.select("concept_id", mean(own, F.col("n") * n_own).alias("intra"), mean(dot(F.col("total"), F.col("all")) - own, F.col("n") * (F.col("n_all") - n_own)).alias("inter"))


def word_breakdown(dist: DataFrame, words: DataFrame) -> DataFrame:
    """dist of pairs and words(id, word) -> per concept and kind of pair (same word, other word, cross-lingual) number and mean similarity."""
    of = lambda k: words.select(F.col("id").alias(k), F.col("word").alias(f"word_{k}"))
    j = dist.join(of("a"), "a").join(of("b"), "b")
    kind = F.when(F.col("lang_a") != F.col("lang_b"), "cross-lingual").when(F.col("word_a") == F.col("word_b"), "same word").otherwise("other word")
    return j.groupBy("concept_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.lit(1.0) - F.col("dist")), 6).alias("mean"))


def raw_vs_projected(raw: DataFrame, projected: DataFrame) -> DataFrame:
    """Per concept: the gap of mean cosines, intra less inter, of raw and of projected rows, and whether projection wins."""
    gap = lambda df, x: intra_inter(df).select("concept_id", F.round(F.col("intra") - F.col("inter"), 6).alias(x))
    return gap(raw, "raw_gap").join(gap(projected, "gap"), "concept_id").withColumn("wins", F.col("gap") > F.col("raw_gap"))


def pair_draws(dist: DataFrame, floor: float, draws: int) -> DataFrame:
    """For each anchor draws pairs of others, in the order of a hash: the closer one is the positive; pairs that differ by less than floor are
    rejected. What pair_grid gives for all pairs, as a sampler sees it."""
    order = F.sha1(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")))
    i = F.row_number().over(Window.partitionBy("concept_id", "a").orderBy(order, "b")) - 1
    two = dist.withColumn("i", i).where(F.col("i") < 2 * draws).groupBy("concept_id", "a", F.floor(F.col("i") / F.lit(2.0)).alias("draw"))
    near = F.struct("dist", "b")
    got = two.agg(F.count(F.lit(1)).alias("n"), F.min(near).alias("p"), F.max(near).alias("q"))
    got = got.withColumn("gap", F.round(F.col("q.dist") - F.col("p.dist"), 6)).where((F.col("n") == 2) & (F.col("gap") >= floor))
    return got.select("concept_id", "a", "draw", F.col("p.b").alias("pos"), F.col("q.b").alias("neg"), "gap")


def audit(samples: DataFrame, most: int, seed: str) -> DataFrame:
    """At most most five-point samples of each concept that have a cross-language side, by a seeded hash of the anchor."""
    order = F.sha1(F.concat(F.lit(f"{seed}:"), F.col("a").cast("string")))
    n = F.row_number().over(Window.partitionBy("concept_id").orderBy(order, "a"))
    return samples.where("has_xl").withColumn("n", n).where(F.col("n") <= most).drop("n")


def sampler_stats(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Per concept: anchors, the share rejected, the share of the others' samples with a cross-language side, and their margins."""
    j = rows.select("concept_id", F.col("id").alias("a")).join(samples.select("concept_id", "a", "has_xl", "margin_sl"), ["concept_id", "a"], "left")
    return j.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("anchors"), F.round(F.avg(F.col("has_xl").isNull().cast("int")), 6).alias("rejected"), F.round(F.avg(F.col("has_xl").cast("int")), 6).alias("with_xl"),
        F.round(F.avg("margin_sl"), 6).alias("margin_mean"), F.round(F.stddev_pop("margin_sl"), 6).alias("margin_std"),
    )
