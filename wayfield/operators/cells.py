"""Cell-pair correlation, clustering of cells, latent components and ranked cell lists."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from wayfield.functions.numeric import corr_from_sums, finite
from wayfield.operators.maps import hd_sectors, mean_map, smooth_map
from wayfield.plans.ordered import in_order
from wayfield.session import cut_lineage


def _pack(df: DataFrame, by: Sequence[str], cell: str, value: str, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per frame with its cells and values as arrays: a frame holds each recorded cell once."""
    packed = df.groupBy(*by).agg(F.collect_list(F.struct(F.col(cell).cast("bigint").alias("c"), F.col(value).cast("double").alias("v"), *extra)).alias("_s"))
    names = ["c", "v", *[f"e{i}" for i in range(len(extra))]]

    def field(name: str) -> Column:
        return F.transform("_s", lambda s: s[name]).alias(f"_{name}")

    return packed.select(*by, *[field(k) for k in names])


def _flat(pdf: pd.DataFrame, names: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    sizes = pdf[names[0]].map(len).to_numpy()
    rows = np.repeat(np.arange(len(pdf)), sizes)
    return rows, [np.concatenate([np.asarray(a) for a in pdf[n]]) if len(pdf) else np.array([]) for n in names]


def coded(df: DataFrame, keys: Sequence[str], cell: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with dense codes for cells that are not whole numbers, and the codes' labels per group, in label order.

    The dictionary has a row per cell of a group. Rows without a cell go.
    """
    if isinstance(df.schema[cell].dataType, IntegralType):
        return df, None
    labels = df.select(*keys, F.col(cell).alias("_label")).dropna(subset=["_label"]).distinct()
    names = cut_lineage(labels.withColumn("_code", F.dense_rank().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("_label")).cast("bigint")))
    left = df.withColumnRenamed(cell, "_label")
    return left.join(names, [*keys, "_label"]).withColumnRenamed("_code", cell).drop("_label"), names


def labelled(pairs: DataFrame, names: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Cell pairs with the labels in place of the codes."""
    if names is None:
        return pairs
    for c in ("cell_a", "cell_b"):
        pairs = pairs.join(names.withColumnRenamed("_code", c), [*keys, c]).drop(c).withColumnRenamed("_label", c)
    return pairs.select(*keys, "cell_a", "cell_b", *[c for c in pairs.columns if c not in (*keys, "cell_a", "cell_b")])


def by_label(fn):
    """A pair operator over whole-number cells, made to take and return cells of any type that can be ordered."""

    @functools.wraps(fn)
    def run(df: DataFrame, keys: Sequence[str], *args, **options) -> DataFrame:
        bound = inspect.signature(fn).bind(df, keys, *args, **options)
        bound.apply_defaults()
        cell = bound.arguments.get("cell", "cell")
        rows, names = coded(df, list(keys), cell)
        bound.arguments["df"] = rows
        return labelled(fn(*bound.args, **bound.kwargs), names, list(keys))

    return run


@by_label
def pair_sums(df: DataFrame, keys: Sequence[str], row: str, cell: str, value: str) -> DataFrame:
    """Pairwise-complete sums for every cell pair (a <= b) that meets in a frame: n, sx, sy, sxx, syy, sxy.

    Frames of one block spread over all tasks; each task adds up matrix products of its frames, so pairs are never
    written per frame and the shuffle carries one partial matrix per block and batch.
    """
    keys = list(keys)
    known = df.filter(finite(value).isNotNull())
    packed = _pack(known, [*keys, row], cell, value)
    schema = df.select(*keys).schema
    for name in ("cell_a", "cell_b"):
        schema = schema.add(name, "long")
    for name in ("n", "sx", "sy", "sxx", "syy", "sxy"):
        schema = schema.add(name, "double")

    def grams(batches):
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False) if keys else [((), pdf)]:
                rows, (cells, values) = _flat(part, ["_c", "_v"])
                ids, col = np.unique(cells, return_inverse=True)
                x = np.zeros((len(part), len(ids)))
                m = np.zeros_like(x)
                x[rows, col], m[rows, col] = values, 1.0
                i, j = np.triu_indices(len(ids))
                n, sx, sxx, sxy = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
                met = n[i, j] > 0
                i, j = i[met], j[met]
                out = pd.DataFrame(
                    {"cell_a": ids[i], "cell_b": ids[j], "n": n[i, j], "sx": sx[i, j], "sy": sx[j, i], "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j]}
                )
                for k, v in zip(keys, key if isinstance(key, tuple) else (key,)):
                    out[k] = v
                yield out[[*keys, *out.columns.drop(keys)]]

    parts = packed.mapInPandas(grams, schema)
    return parts.groupBy(*keys, "cell_a", "cell_b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def corr_by_block(df: DataFrame, keys: Sequence[str], row: str, cell: str = "cell", value: str = "rate") -> DataFrame:
    """Pearson correlation of all cell pairs per block over the frames both have; 0 where it is undefined."""
    s = pair_sums(df, keys, row, cell, value)
    r = corr_from_sums(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return s.select(*keys, "cell_a", "cell_b", r.alias("r"))


def cross_sums(df: DataFrame, keys: Sequence[str], row: str, cell: str, value: str, max_shift: int = 0) -> DataFrame:
    """``sxy`` of cell a at a row and cell b ``shift`` rows later, for all ordered pairs; absent values are 0.

    Each value is sent to the ``max_shift`` earlier rows as well, so a row meets its partners without a join.
    """
    keys = list(keys)
    sent = df.filter(finite(value).isNotNull()).select(*keys, F.col(row).alias("_row"), cell, value, F.explode(F.sequence(F.lit(0), F.lit(max_shift))).alias("_shift"))
    sent = sent.withColumn("_row", F.col("_row") - F.col("_shift"))
    packed = _pack(sent, [*keys, "_row"], cell, value, [F.col("_shift").alias("e0")])
    schema = df.select(*keys).schema.add("shift", "integer").add("cell_a", "long").add("cell_b", "long").add("sxy", "double")

    def grams(batches):
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False) if keys else [((), pdf)]:
                rows, (cells, values, shifts) = _flat(part, ["_c", "_v", "_e0"])
                ids, col = np.unique(cells, return_inverse=True)
                layers = np.zeros((max_shift + 1, len(part), len(ids)))
                layers[shifts.astype(int), rows, col] = values
                a, b = np.meshgrid(ids, ids, indexing="ij")
                for s in range(max_shift + 1):
                    out = pd.DataFrame({"shift": np.int32(s), "cell_a": a.ravel(), "cell_b": b.ravel(), "sxy": (layers[0].T @ layers[s]).ravel()})
                    for k, v in zip(keys, key if isinstance(key, tuple) else (key,)):
                        out[k] = v
                    yield out[[*keys, "shift", "cell_a", "cell_b", "sxy"]]

    parts = packed.mapInPandas(grams, schema)
    return parts.groupBy(*keys, "shift", "cell_a", "cell_b").agg(F.sum("sxy").alias("sxy"))


def corr_zero_filled(df: DataFrame, keys: Sequence[str], row: str, cell: str, value: str, n: int) -> DataFrame:
    """Correlation over ``n`` rows per block where a row without a value counts as 0."""
    keys = list(keys)
    sums = df.groupBy(*keys, cell).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    cross = cross_sums(df, keys, row, cell, value).filter("cell_a <= cell_b").drop("shift")
    a = sums.select(*keys, F.col(cell).cast("bigint").alias("cell_a"), F.col("s").alias("sx"), F.col("ss").alias("sxx"))
    b = sums.select(*keys, F.col(cell).cast("bigint").alias("cell_b"), F.col("s").alias("sy"), F.col("ss").alias("syy"))
    both = cross.join(a, [*keys, "cell_a"]).join(b, [*keys, "cell_b"])
    r = corr_from_sums(F.lit(float(n)), *[F.col(c) for c in ("sx", "sy", "sxx", "syy", "sxy")])
    return both.select(*keys, "cell_a", "cell_b", r.alias("r"))


@by_label
def corr_phase_shift(df: DataFrame, keys: Sequence[str], row: str, block_rows: int, max_shift: int = 3, cell: str = "cell", value: str = "rate") -> DataFrame:
    """Largest correlation of each cell pair over shifts of up to ``max_shift`` rows, blocks padded with zeros.

    ``row`` counts 0 to ``block_rows - 1`` inside each block and absent values are 0. A negative shift of (a, b) is the
    positive shift of (b, a), so the result is symmetric and given for a <= b.
    """
    keys = list(keys)
    cross = cross_sums(df, keys, row, cell, value, max_shift)
    shifts = F.explode(F.sequence(F.lit(0), F.lit(max_shift))).alias("shift")
    v = F.when(F.col(row) >= F.col("shift"), F.col(value).cast("double"))
    late = df.select(*keys, row, cell, value, shifts).groupBy(*keys, "shift", cell).agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sy"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("syy")
    )
    first = late.filter("shift = 0").select(*keys, F.col(cell).cast("bigint").alias("cell_a"), F.col("sy").alias("sx"), F.col("syy").alias("sxx"))
    second = late.select(*keys, "shift", F.col(cell).cast("bigint").alias("cell_b"), "sy", "syy")
    both = cross.join(first, [*keys, "cell_a"]).join(second, [*keys, "shift", "cell_b"])
    r = corr_from_sums(F.lit(float(block_rows)), *[F.col(c) for c in ("sx", "sy", "sxx", "syy", "sxy")])
    pair = both.select(*keys, F.least("cell_a", "cell_b").alias("cell_a"), F.greatest("cell_a", "cell_b").alias("cell_b"), r.alias("r"))
    return pair.groupBy(*keys, "cell_a", "cell_b").agg(F.max("r").alias("r"))


@by_label
def corr_by_position(df: DataFrame, keys: Sequence[str], n: int = 34, lo: float = 0.0, hi: float = 1.0, value: str = "rate", sigma: float = 2.0, kernel_size: int = 8) -> DataFrame:
    """Correlation of the cells' smoothed mean-rate maps over all n*n bins, per block."""
    by = [*keys, "cell"]
    smooth = smooth_map(mean_map(df, by, value, n, lo, hi), by, n, sigma, kernel_size)
    return corr_zero_filled(smooth.withColumn("bin", F.col("bx") * n + F.col("by")), keys, "bin", "cell", "value", n * n)


@by_label
def corr_by_hd(df: DataFrame, keys: Sequence[str], sectors: int = 36, value: str = "rate", hd: str = "hd") -> DataFrame:
    """Correlation of the cells' mean rates over head-direction sectors, per block."""
    return corr_zero_filled(hd_sectors(df, [*keys, "cell"], sectors, value, hd), keys, "ai", "cell", "value", sectors)


# ---------------------------------------------------------------- clusters


def norm_clusters(
    df: DataFrame, max_clusters: int = 100, min_cells: int = 5, significant: float = 0.1, cell: str = "cell", embedding: str = "embedding", seeds_per_pass: int = 256
) -> DataFrame:
    """Greedy clusters around the cells of largest norm; label 0 for cells in no cluster.

    A free cell belongs to a seed when it is nearer to it than to the origin over the seed's significant dimensions,
    which is one dot product. A seed with fewer than ``min_cells`` members is passed over (and may still join a later
    cluster). The whole state is the list of accepted seeds, at most ``max_clusters`` vectors: a cell's label is the
    first of them it belongs to. None of the passes shuffles cells, and no lineage grows.

    A round tries ``seeds_per_pass`` free seeds at once. Seeds with too few members even alone are out. The others are
    counted as if every seed before them were accepted, each cell counting for the first that it belongs to. That holds up to the
    first seed with too few members; beyond it counts are lower bounds, which still accept, so a round ends only at a
    seed that lacks members or freedom because of one passed over.
    """
    base = df.select(F.col(cell).alias("cell"), F.col(embedding).cast("array<double>").alias("e"))
    norm = F.aggregate("e", F.lit(0.0), lambda a, v: a + v * v)
    ranked = base.withColumn("norm", norm).filter(F.col("norm") > 0)
    normals: list[np.ndarray] = []
    limits: list[float] = []

    def member_test(vector: np.ndarray) -> tuple[np.ndarray, float]:
        kept = np.where(vector**2 / np.max(vector**2) > significant, vector, 0.0)
        return kept, float(kept @ kept) / 2

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        return np.stack(pdf["e"].to_numpy()) if len(pdf) else np.zeros((0, 1))

    def labels_of(x: np.ndarray, seeds: list[np.ndarray], cuts: list[float]) -> np.ndarray:
        if not seeds or not len(x):
            return np.zeros(len(x), dtype="int32")
        hit = x @ np.stack(seeds).T > np.array(cuts)
        return np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, 0).astype("int32")

    def free_rows(seeds: list[np.ndarray], cuts: list[float]):
        def keep(batches):
            for pdf in batches:
                yield pdf[labels_of(matrix(pdf), seeds, cuts) == 0]
        return keep

    def count_members(seeds, cuts, tests, levels, first_only: bool):
        def count(batches):
            total = np.zeros(len(tests), dtype="int64")
            for pdf in batches:
                x = matrix(pdf)
                x = x[labels_of(x, seeds, cuts) == 0]
                if not len(x):
                    continue
                hits = x @ np.stack(tests).T > np.array(levels)
                total += np.bincount(hits.argmax(axis=1)[hits.any(axis=1)], minlength=len(tests)) if first_only else hits.sum(axis=0)
            yield pd.DataFrame({"seed": np.arange(len(tests)), "n": total})
        return count

    def counted(tests: list[np.ndarray], levels: list[float], first_only: bool) -> list[int]:
        # one row per seed and task
        rows = base.mapInPandas(count_members(list(normals), list(limits), tests, levels, first_only), "seed int, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
        sizes = {r["seed"]: r["n"] for r in rows.collect()}
        return [sizes.get(i, 0) for i in range(len(tests))]

    after = None
    while len(normals) < max_clusters:
        pool = ranked if after is None else ranked.filter((F.col("norm") < after[0]) | ((F.col("norm") == after[0]) & (F.col("cell") < after[1])))
        # a fixed number of candidate vectors, not a share of the data
        free = pool.mapInPandas(free_rows(list(normals), list(limits)), pool.schema)
        batch = free.orderBy(F.desc("norm"), F.desc("cell")).limit(seeds_per_pass).collect()
        if not batch:
            break
        vectors = [np.array(r["e"]) for r in batch]
        tests, levels = (list(v) for v in zip(*map(member_test, vectors)))
        alone = counted(tests, levels, False)
        # as if all of them were accepted: a seed that an earlier one holds would not be free
        assumed: list[int] = []
        for i, v in enumerate(vectors):
            if alone[i] >= min_cells and not any(v @ tests[j] > levels[j] for j in assumed):
                assumed.append(i)
        sizes = dict(zip(assumed, counted([tests[i] for i in assumed], [levels[i] for i in assumed], True))) if assumed else {}
        passed_over, stop = False, len(batch) - 1
        taken: list[int] = []
        for i, v in enumerate(vectors):
            if alone[i] < min_cells or any(v @ tests[j] > levels[j] for j in taken):
                continue
            if len(normals) + len(taken) >= max_clusters:
                break
            if sizes.get(i, 0) >= min_cells:
                taken.append(i)
            elif i in sizes and not passed_over:
                passed_over = True
            else:
                # it hangs on a seed that was passed over: the next round starts with it
                stop = i - 1
                break
        after = (batch[stop]["norm"], batch[stop]["cell"])
        normals += [tests[i] for i in taken]
        limits += [levels[i] for i in taken]

    def assign(batches):
        for pdf in batches:
            yield pd.DataFrame({"cell": pdf["cell"], "cluster": labels_of(matrix(pdf), normals, limits)})

    return base.mapInPandas(assign, base.select("cell").schema.add("cluster", "integer"))


def merge_clusters(corr: DataFrame, clusters: DataFrame, threshold: float = 0.5, weak: float = 0.1, keys: Sequence[str] = (), max_clusters: int = 1000) -> DataFrame:
    """Merge clusters until no pair qualifies; the second label of a pair becomes the first (smaller) one.

    ``corr(keys…, cell_a, cell_b, r)`` holds every unordered cell pair of a group once, ``clusters(keys…, cell, cluster)`` one
    label per cell. Pairs are tried in order of falling mean correlation. Cell pairs are summed to cluster pairs by one
    aggregate; the matrix of sums, at most ``max_clusters`` a side (more raise an error), is merged in one task per group, as a
    merge only adds up rows and columns of it.
    """
    named, keys = {f"_k{i}": c for i, c in enumerate(keys)}, [f"_k{i}" for i in range(len(keys))] or ["_all"]
    group = [F.col(c).alias(k) for k, c in named.items()] or [F.lit(0).alias("_all")]
    labels = clusters.select(*group, "cell", "cluster")
    a = labels.withColumnsRenamed({"cell": "cell_a", "cluster": "ca"})
    b = labels.withColumnsRenamed({"cell": "cell_b", "cluster": "cb"})
    pairs = corr.filter("cell_a <> cell_b").select(*group, "cell_a", "cell_b", "r").join(a, [*keys, "cell_a"]).join(b, [*keys, "cell_b"])
    sums = pairs.groupBy(*keys, F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([pdf["ca"], pdf["cb"]]), return_inverse=True)
        c = len(names)
        if c > max_clusters:
            raise ValueError(f"{c} clusters, at most {max_clusters} are merged")
        i, j = at[: len(pdf)], at[len(pdf) :]
        s, n = np.zeros((c, c)), np.zeros((c, c))
        for m, v in ((s, pdf["s"].to_numpy(float)), (n, pdf["n"].to_numpy(float))):
            m[i, j] = v
            m[j, i] = v
        merged, live = np.arange(c), np.ones(c, dtype=bool)
        upper = np.triu(np.ones((c, c), dtype=bool), 1)
        while True:
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = s / n
                intra = np.diag(mean)
                top, low = np.maximum(intra[:, None], intra), np.minimum(intra[:, None], intra)
                rule = ((mean / top > threshold) & (low / top < threshold) & (top != 0)) | (top < weak)
            rule &= upper & live[:, None] & live & (n > 0) & np.isfinite(top)
            if not rule.any():
                break
            # the highest mean; of equal ones the first pair of labels
            keep, gone = np.unravel_index(np.argmax(np.where(rule, mean, -np.inf)), rule.shape)
            for m in (s, n):
                inner = m[keep, keep] + m[gone, gone] + m[keep, gone]
                m[keep] += m[gone]
                m[:, keep] = m[keep]
                m[keep, keep] = inner
            live[gone] = False
            merged[merged == gone] = keep
        first = pdf[keys].iloc[[0] * c].reset_index(drop=True)
        return first.assign(cluster=names, merged=names[merged])

    schema = labels.select(*keys, "cluster").schema.add("merged", labels.schema["cluster"].dataType)
    mapping = sums.groupBy(*keys).applyInPandas(merge, schema)
    out = labels.join(mapping, [*keys, "cluster"], "left")
    return out.select(*keys, "cell", F.coalesce("merged", "cluster").cast("int").alias("cluster")).drop("_all").withColumnsRenamed(named)


def latent_pca(df: DataFrame, k: int = 3, ids: Sequence[str] = ("cell",), vector: str = "embedding") -> DataFrame:
    """First ``k`` principal components of each row's vector (columns PC1…PCk)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.select(*ids, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(data)
    loadings = model.pc.toArray()
    # the direction of a component is free: its largest loading is made positive
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    out = model.transform(data).withColumn("_pc", vector_to_array("_pc"))
    return out.select(*ids, *[(F.get("_pc", F.lit(i)) * float(signs[i])).alias(f"PC{i + 1}") for i in range(k)])


# ---------------------------------------------------------------- ranked lists


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 32) -> DataFrame:
    """The first ``n`` rows of each group with their rank ``_r``: first per salt, then among what the salts keep.

    So no task sorts a whole group, whatever ``n`` is; the second step sees at most ``salts`` times n rows of a group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    near = salted.withColumn("_r", rank(*keys, "_salt")).filter(F.col("_r") <= n).drop("_salt")
    return near.withColumn("_r", rank(*keys)).filter(F.col("_r") <= n)


def rank_in_room(df: DataFrame, score: str = "score", room: str = "room", cell: str = "cell") -> DataFrame:
    """Rank by falling score per room; ties share their average rank, cut to an integer.

    Equal scores are counted before anything is ordered: a score that most rows share is one row of the ordered table.
    """
    ties = df.groupBy(room, score).agg(F.count(F.lit(1)).alias("_n")).withColumn("_d", -F.col(score))
    placed = in_order(ties, [room], "_d", running={"_upto": F.col("_n")})
    rank = F.floor(F.col("_upto") - F.col("_n") + 1 + (F.col("_n") - 1) / 2).cast("int")
    return df.join(placed.select(room, score, rank.alias("rank")), [room, score]).select(*df.columns, "rank")


def low_mid_high_cells(df: DataFrame, n: int, low: int, high: int, rate: str = "rate", cell: str = "cell") -> DataFrame:
    """Cells with the lowest and highest mean rate and those closest to the middle rank."""
    ranked = in_order(df.groupBy(cell).agg(F.avg(rate).alias("mean_rate")), [], "mean_rate", [cell], index="_i")
    # ranks below ``bottom`` and from ``top`` on are the ends; what the budget leaves goes to ranks around their middle
    total = ranked.count()
    bottom = min(low, n, total)
    top = total - min(high, max(0, min(n, total) - bottom))
    spare = max(0, min(n, total) - low - high)
    kind = F.when(F.col("_i") < bottom, "low").when(F.col("_i") >= top, "high").otherwise("mid")
    named = ranked.select(cell, "mean_rate", kind.alias("kind"), F.abs(2 * F.col("_i") - (bottom + top - 1)).alias("_far"))
    middle = named.filter("kind = 'mid'").orderBy("_far", "mean_rate", cell).limit(spare)
    return named.filter("kind <> 'mid'").unionByName(middle).drop("_far")


def top_overlap(df: DataFrame, room_a: str, room_b: str, n: int, score: str = "score", room: str = "room", cell: str = "cell") -> DataFrame:
    """Scores of both rooms per cell and whether the cell is among the top ``n`` of ``both``, ``a``, ``b`` or ``none``."""
    wide = df.filter(F.col(room).isin(room_a, room_b)).groupBy(cell).agg(
        F.max(F.when(F.col(room) == room_a, F.col(score))).alias("score_a"), F.max(F.when(F.col(room) == room_b, F.col(score))).alias("score_b")
    ).dropna(subset=["score_a", "score_b"])
    out = wide
    for side in ("a", "b"):
        # n rows each
        top = wide.orderBy(F.desc(f"score_{side}"), cell).limit(n).select(cell, F.lit(True).alias(f"_{side}"))
        out = out.join(top, cell, "left")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    label = F.when(in_a & in_b, "both").when(in_a, "a").when(in_b, "b").otherwise("none")
    return out.select(cell, "score_a", "score_b", label.alias("overlap"))


def top_n_threshold(df: DataFrame, n: int, score: str = "score", room: str = "room", cell: str = "cell") -> DataFrame:
    """Flag each room's top ``n`` cells; the threshold is the mean of the n-th and the next score."""
    top = top_rows(df, [room], [F.desc(score), F.col(cell)], n + 1)
    cut = top.groupBy(room).agg(F.avg(F.when(F.col("_r") >= n, F.col(score))).alias("threshold"))
    flagged = top.filter(F.col("_r") <= n).select(room, cell, F.lit(True).alias("is_top"))
    out = df.join(cut, room).join(flagged, [room, cell], "left")
    return out.withColumn("is_top", F.coalesce("is_top", F.lit(False)))


def limit_per_cluster(df: DataFrame, m: int, cluster: str = "cluster_label", cell: str = "cell") -> DataFrame:
    """First ``m`` cells of each cluster."""
    return top_rows(df, [cluster], [F.col(cell)], m).drop("_r")


def sample_per_room(df: DataFrame, budget: int, n_rooms: int, seed: int = 0, room: str = "room", row: str = "row_key") -> DataFrame:
    """``budget / n_rooms`` rows of each room, picked by a seeded digest of the row's key so that runs agree."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row).cast("string")))
    return top_rows(df, [room], [drawn, F.col(row)], max(1, budget // n_rooms)).drop("_r")


def peak_bin(maps: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Bin with the largest value; of equal ones the first in row-major (by, bx) order."""
    best = maps.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max(F.struct(F.col(value).alias("v"), (-F.col("by")).alias("y"), (-F.col("bx")).alias("x"))).alias("_b")
    )
    return best.select(*keys, (-F.col("_b.x")).alias("bx"), (-F.col("_b.y")).alias("by"), F.col("_b.v").alias("peak"))


def first_groups(df: DataFrame, keys: Sequence[str], m: int) -> DataFrame:
    """Rows of the first ``m`` groups in key order."""
    groups = df.select(*keys).distinct().orderBy(*keys).limit(m)
    return df.join(groups, list(keys), "left_semi")


def loss_curves(df: DataFrame, set_name: str = "set_name", epoch: str = "epoch", loss: str = "mse") -> DataFrame:
    """Mean loss per set and epoch, with the set's best epoch."""
    curve = df.groupBy(set_name, epoch).agg(F.avg(loss).alias("loss"))
    best = curve.groupBy(set_name).agg(F.min_by(epoch, "loss").alias("best_epoch"))
    return curve.join(best, set_name)
