"""Clustering, anomaly detection and projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.values import quoted, rounded, safe_ratio
from tabloom.operators.features import FeatureConfig, build_preprocessor, feature_names
from tabloom.operators.neighbours import (
    BLOCK_CELLS,
    BLOCK_ROWS,
    BLOCKS_A_SIDE,
    _stack,
    flag_share,
    local_outlier_factor,
    pair_blocks,
    pair_distances,
    screened,
    within,
)
from tabloom.plans.graphs import connected_components
from tabloom.plans.ordering import HASH_RANGE, evenly_spaced, with_position
from tabloom.plans.skew import join_weighted
from tabloom.session import cut_lineage

TREES = 200
TREE_ROWS = 256
PIECE_ROWS = 64  # of a piece in a block
DRIVER_EDGES = 200_000


def kmeans(df: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(id, label) and one row with k and inertia; k shrinks to fit few rows."""
    n = df.count()
    k = min(k, max(2, n - 1))
    vectors = df.select("id", array_to_vector("vec").alias("features"))
    model = KMeans(k=k, seed=seed, predictionCol="label").fit(vectors)
    inertia = df.sparkSession.createDataFrame(
        [(k, float(model.summary.trainingCost))], "k int, inertia double"
    )
    return model.transform(vectors).select("id", "label"), inertia


def _local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member position of each connected component of a small graph."""
    root = np.arange(n, dtype="int32")
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def dbscan(
    df: DataFrame,
    eps: float,
    min_samples: int,
    block_rows: int = BLOCK_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """(id, label): density clusters numbered by their smallest core id, noise −1.

    Copies of a vector are one weighted point.  Every point first meets a bounded draw of the points: who has
    enough neighbours there is a core point, and core points that meet the same drawn ones are one piece of a cluster.
    Blocks then count for the undecided points only, and look for links between different pieces only, so what a
    dense region has settled is not compared again.  They pass on one edge per piece or border point, never pairs.
    """
    unique = cut_lineage(
        df.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    )
    size = unique.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    most = max(block_rows, min(BLOCK_CELLS // max(1, size["d"] or 1), -(-size["n"] // BLOCKS_A_SIDE)))
    limit = F.lit(int(min(1.0, most / max(1, size["n"])) * HASH_RANGE))
    drawn = F.pmod(F.xxhash64(F.lit(31), "id"), F.lit(HASH_RANGE)) < limit
    blocks = {"eps": eps, "block_rows": block_rows, "pivots": pivots}

    flagged = _with_core(unique, drawn, min_samples, blocks)
    cores = flagged.where("core")
    own = _pieces(cores, drawn, eps)
    pieces = cut_lineage(own.groupBy("root").agg(F.min("id").alias("piece"), F.count("*").alias("n")))
    named = cut_lineage(join_weighted(own, pieces, ["root"], "n").select("id", "piece"))
    pieces = pieces.select("piece", "n")
    largest = pieces.orderBy(F.desc("n"), "piece").first()
    flagged = cut_lineage(flagged.join(named, "id", "left"))
    open_ones = flagged.where(~F.col("core") | (F.col("piece") != F.lit(largest["piece"] if largest else None)))
    loops = pieces.select(F.col("piece").alias("u"), F.col("piece").alias("v"), F.lit(True).alias("core"))
    links = loops
    if largest and not open_ones.isEmpty():
        asked = open_ones.select("id", "vec", "core", F.coalesce("piece", "id").alias("piece"))
        met = pair_blocks(asked, flagged.where("core").select("id", "vec", "piece"), **blocks)
        links = met.run(_linker(eps), "u bigint, v bigint, core boolean").unionByName(loops).distinct()
    links = cut_lineage(links)
    components = _components(links.where("core").select("u", "v"))
    clusters = with_position(components.select("component").distinct(), ["component"])
    clusters = clusters.select("component", F.col("_pos").cast("int").alias("label"))
    labels = components.join(clusters, "component").select(F.col("id").alias("piece"), "label")
    labels = cut_lineage(labels.join(pieces, "piece"))
    core_labels = join_weighted(named, labels, ["piece"], "n").select("id", "label")
    border = links.where(~F.col("core")).select(F.col("u").alias("id"), F.col("v").alias("piece"))
    border_labels = join_weighted(border, labels, ["piece"], "n").groupBy("id").agg(F.min("label").alias("label"))
    by_vector = core_labels.unionByName(border_labels)
    labelled = unique.select("id", "vec").join(by_vector, "id", "left").select(
        "vec", F.coalesce("label", F.lit(-1)).alias("label")
    )
    return df.select("id", "vec").join(labelled, "vec").select("id", "label")


def _components(edges: DataFrame) -> DataFrame:
    """``connected_components``; a bounded number of edges is joined in the driver, as every round costs several jobs."""
    few = edges.limit(DRIVER_EDGES + 1).toPandas()
    if len(few) > DRIVER_EDGES:
        return connected_components(edges)
    u, v = few["u"].to_numpy("int64"), few["v"].to_numpy("int64")
    ids = np.unique(np.concatenate([u, v]))
    roots = _local_roots(len(ids), np.searchsorted(ids, u), np.searchsorted(ids, v))
    found = pd.DataFrame({"id": ids, "component": ids[roots]})
    return edges.sparkSession.createDataFrame(found, "id bigint, component bigint")


def _counted(q: np.ndarray, b: np.ndarray, weight: np.ndarray, eps: float) -> np.ndarray:
    """How many points, copies included, lie within ``eps`` of every query."""
    copies = weight - 1
    more = np.flatnonzero(copies)
    n = [np.count_nonzero(near, axis=1) + near[:, more] @ copies[more] for _, near in within(q, b, eps)]
    return np.concatenate(n)


def _with_core(unique: DataFrame, drawn: Column, min_samples: int, blocks: dict) -> DataFrame:
    """(id, vec, core): counted among the drawn points, then among all where that is not enough."""
    eps, some = blocks["eps"], unique.where(drawn).select("vec", "weight").toPandas()
    base, weight = _stack(some["vec"]), some["weight"].to_numpy()
    shared = unique.sparkSession.sparkContext.broadcast((base, weight))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, weight = shared.value
        for batch in batches:
            n = _counted(_stack(batch["vec"]), base, weight, eps) if len(batch) and len(base) else 0
            yield batch.assign(sure=np.asarray(n) >= min_samples)

    seen = cut_lineage(unique.mapInPandas(meet, "vec array<double>, id bigint, weight bigint, sure boolean"))
    unsure = seen.where("NOT sure")
    if unsure.isEmpty():
        return seen.select("id", "vec", F.col("sure").alias("core"))

    def count(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(b) == 0:
            return pd.DataFrame({"id": [], "n": []})
        return pd.DataFrame({"id": q["id"], "n": _counted(_stack(q["vec"]), _stack(b["vec"]), b["weight"].to_numpy(), eps)})

    met = pair_blocks(unsure.select("id", "vec"), seen.select("id", "vec", "weight"), **blocks)
    counts = met.run(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    core = F.col("sure") | (F.coalesce("n", F.lit(0)) >= min_samples)
    return cut_lineage(seen.join(counts, "id", "left").select("id", "vec", core.alias("core")))


def _pieces(cores: DataFrame, drawn: Column, eps: float) -> DataFrame:
    """(id, root): core points that reach each other over drawn core points share a root; others are their own."""
    some = cores.where(drawn).select("id", "vec").toPandas()
    shared = cores.sparkSession.sparkContext.broadcast((some["id"].to_numpy(), _stack(some["vec"])))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, base = shared.value
        places = np.arange(len(ids), dtype="int32")
        joined = places
        for batch in batches:
            if len(batch) == 0:
                continue
            own = batch["id"].to_numpy()
            reached = own.copy()
            for start, near in within(_stack(batch["vec"]), base, eps) if len(ids) else ():
                first = near.argmax(axis=1)
                found = near[np.arange(len(near)), first]
                reached[start : start + len(near)][found] = ids[first[found]]
                qi, bi = np.nonzero(near & (joined[first][:, None] != joined))
                if len(qi):
                    joined = _local_roots(len(ids), np.concatenate([places, first[qi]]), np.concatenate([joined, bi]))
            yield pd.DataFrame({"u": own, "v": reached, "own": True})
        moved = joined != places
        yield pd.DataFrame({"u": ids[moved], "v": ids[joined[moved]], "own": False})

    met = cut_lineage(cores.select("id", "vec").mapInPandas(meet, "u bigint, v bigint, own boolean"))
    own = met.where("own").select(F.col("u").alias("id"), "v")
    # At most one row for each drawn point.
    roots = F.broadcast(_components(met.where("NOT own").select("u", "v")).toDF("v", "root"))
    return cut_lineage(own.join(roots, "v", "left").select("id", F.coalesce("root", "v").alias("root")))


def _linker(eps: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Links of a block between different pieces: of pieces, and of border points to pieces."""

    def link(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(b) == 0:
            return pd.DataFrame({"u": [], "v": [], "core": []})
        q_ids, core = q["id"].to_numpy(), q["core"].to_numpy().astype(bool)
        q_pieces, b_pieces = q["piece"].to_numpy(), b["piece"].to_numpy()
        ids = np.unique(np.concatenate([b_pieces, q_pieces[core]]))
        places = np.arange(len(ids), dtype="int32")
        left, right = np.searchsorted(ids, q_pieces), np.searchsorted(ids, b_pieces)
        queries, base = _stack(q["vec"]), _stack(b["vec"])
        joined, border = places, []
        # Core points of a large piece don't meet their own piece.
        held = np.bincount(left[core], minlength=len(ids))
        parts = [(np.flatnonzero(core & (left == p)), np.flatnonzero(right != p)) for p in np.flatnonzero(held >= PIECE_ROWS)]
        parts.append((np.flatnonzero(~core | (held[np.minimum(left, len(ids) - 1)] < PIECE_ROWS)), np.arange(len(b))))
        for asked, given in parts:
            if not len(asked) or not len(given):
                continue
            for start, near in within(queries[asked], base[given], eps):
                rows, to = asked[start : start + len(near)], right[given]
                inner = core[rows]
                own = np.where(inner, joined[np.minimum(left[rows], len(ids) - 1)], -1)
                qi, bi = np.nonzero(near & inner[:, None] & (own[:, None] != joined[to]))
                if len(qi):
                    known = np.concatenate([joined, to[bi]])
                    joined = _local_roots(len(ids), np.concatenate([places, left[rows[qi]]]), known)
                outer = np.flatnonzero(~inner)  # each has fewer than ``min_samples`` links
                qi, bi = np.nonzero(near[outer])
                border.append(np.unique(rows[outer[qi]] * len(ids) + joined[to[bi]].astype("int64")))
        roots = ids[joined]
        moved = roots != ids
        rows = [pd.DataFrame({"u": ids[moved], "v": roots[moved], "core": True})]
        if border:
            qi, root = np.divmod(np.concatenate(border), len(ids))
            rows.append(pd.DataFrame({"u": q_ids[qi], "v": roots[root], "core": False}).drop_duplicates())
        return pd.concat(rows, ignore_index=True)

    return link


def silhouette(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean Euclidean silhouette of labelled points, noise (−1) left out.

    Exact and therefore quadratic in the number of points; blocks return one
    distance sum per point and cluster.  ``silhouette_squared`` is linear.
    """
    kept = df.where(F.col("label") != -1).select("id", "vec", F.col("label").cast("int").alias("label"))
    blocks = pair_blocks(kept, kept, block_rows=block_rows)

    def sums(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(b) == 0:
            return pd.DataFrame({"id": [], "own": [], "other": [], "s": []})
        queries, base = _stack(q["vec"]), _stack(b["vec"])
        names, codes = np.unique(b["label"].to_numpy(), return_inverse=True)
        member, parts = np.eye(len(names))[codes], []
        for start, squares, slack in screened(queries, base):
            # Roots of small differences of large numbers are taken again, by plain differences.
            qi, bi = np.nonzero(~(squares > 1e6 * slack))
            squares[qi, bi] = 0.0
            gaps = np.sqrt(squares, out=squares)
            gaps[qi, bi] = pair_distances(queries[start : start + len(gaps)], base, qi, bi)
            parts.append(gaps @ member)
        totals = np.concatenate(parts)
        return pd.DataFrame(
            {
                "id": np.repeat(q["id"].to_numpy(), len(names)),
                "own": np.repeat(q["label"].to_numpy(), len(names)),
                "other": np.tile(names, len(q)),
                "s": totals.ravel(),
            }
        )

    by_cluster = (
        blocks.run(sums, "id bigint, own int, other int, s double")
        .groupBy("id", "own", "other")
        .agg(F.sum("s").alias("s"))
    )
    sizes = kept.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("size"))
    means = by_cluster.join(sizes, "other")
    own = F.col("own") == F.col("other")
    per_point = means.groupBy("id").agg(
        F.max(F.when(own, F.col("s") / F.nullif(F.col("size") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~own, F.col("s") / F.col("size"))).alias("b"),
    )
    value = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    return per_point.agg(rounded(F.avg(value)).alias("silhouette"))


def silhouette_squared(df: DataFrame) -> DataFrame:
    """Squared-Euclidean silhouette from per-cluster moments: one shuffle, linear."""
    kept = df.where(F.col("label") != -1)
    dims = F.posexplode("vec").alias("d", "x")
    stats = (
        kept.select("label", "id", dims)
        .groupBy("label", "d")
        .agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.count("*").alias("n"))
        .groupBy("label")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("d", "sx"))), lambda s: s["sx"]).alias("centre"),
            F.sum("sxx").alias("norms"),
            F.max("n").alias("n"),
        )
    )
    every = stats.agg(F.collect_list(F.struct("label", "centre", "norms", "n")).alias("clusters"))
    own_norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)

    def total(c):
        dot = F.aggregate(F.zip_with("vec", c["centre"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return c["n"] * F.col("norm") + c["norms"] - 2 * dot

    rows = kept.withColumn("norm", own_norm).crossJoin(F.broadcast(every))
    scored = rows.select(
        F.transform(
            F.filter("clusters", lambda c: c["label"] == F.col("label")),
            lambda c: total(c) / F.nullif(c["n"] - 1, F.lit(0)),
        )[0].alias("a"),
        F.array_min(
            F.transform(F.filter("clusters", lambda c: c["label"] != F.col("label")), lambda c: total(c) / c["n"])
        ).alias("b"),
    )
    value = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    return scored.agg(rounded(F.avg(value)).alias("silhouette_squared"))


def davies_bouldin(df: DataFrame) -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / centre distance."""
    kept = df.where(F.col("label") != -1).select("label", "vec")
    centres = kept.groupBy("label").agg(
        vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("centre")
    )

    def gap(a, b):
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))

    scatter = (
        kept.join(centres, "label")
        .groupBy("label", "centre")
        .agg(F.avg(gap(F.col("vec"), F.col("centre"))).alias("scatter"))
    )
    # One row per cluster: the list of clusters is as long as k.
    every = scatter.agg(F.collect_list(F.struct("label", "centre", "scatter")).alias("others"))
    worst = F.array_max(
        F.transform(
            F.filter("others", lambda o: o["label"] != F.col("label")),
            lambda o: (F.col("scatter") + o["scatter"]) / F.nullif(gap(F.col("centre"), o["centre"]), F.lit(0.0)),
        )
    )
    per_cluster = scatter.crossJoin(F.broadcast(every)).select(worst.alias("w"))
    return per_cluster.agg(rounded(F.avg("w")).alias("davies_bouldin"))


def cluster_profile(labelled: DataFrame) -> DataFrame:
    """(label, count, ratio, cluster_count, noise_ratio)."""
    counts = labelled.groupBy("label").agg(F.count("*").alias("count"))
    total = counts.agg(
        F.sum("count").alias("n"),
        F.count_if(F.col("label") != -1).alias("cluster_count"),
        F.coalesce(F.sum(F.when(F.col("label") == -1, F.col("count"))), F.lit(0)).alias("noise"),
    )
    return counts.crossJoin(F.broadcast(total)).select(
        "label",
        "count",
        safe_ratio(F.col("count"), F.col("n")).alias("ratio"),
        "cluster_count",
        safe_ratio(F.col("noise"), F.col("n")).alias("noise_ratio"),
    )


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def _grow(rows: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Isolation tree as a flat list of (feature, cut, left, right, depth value)."""
    nodes: list[tuple] = []

    def build(part: np.ndarray, depth: int) -> int:
        position = len(nodes)
        nodes.append(())
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(rows.shape[1])
        usable = np.nonzero(spread > 0)[0]
        if depth >= depth_limit or len(part) <= 1 or len(usable) == 0:
            nodes[position] = (-1, 0.0, -1, -1, depth + _average_path(len(part)))
            return position
        feature = int(rng.choice(usable))
        low, high = part[:, feature].min(), part[:, feature].max()
        cut = float(rng.uniform(low, high))
        left = build(part[part[:, feature] <= cut], depth + 1)
        right = build(part[part[:, feature] > cut], depth + 1)
        nodes[position] = (feature, cut, left, right, 0.0)
        return position

    build(rows, 0)
    return nodes


def isolation_forest(
    df: DataFrame,
    contamination: float = 0.1,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    seed: int = 42,
) -> DataFrame:
    """(id, score, is_outlier): 2^(−mean path / expected path), high is odd.

    Trees are grown in parallel from bounded samples; rows are scored in Arrow
    batches against the small forest.
    """
    spark = df.sparkSession
    # Every tree draws from the whole table: a row names, inside itself, the few trees
    # whose hash of it is low enough, with a margin over the rows a tree needs.
    chance = min(1.0, (tree_rows + 8 * tree_rows**0.5 + 16) / max(1, df.count()))
    low = int(-(1 << 63) + chance * (1 << 64))
    drawn = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.xxhash64(F.lit(seed), t, F.col("id")) <= min(low, (1 << 63) - 1),
    )
    per_tree = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed), "tree", "id"), "id")
    samples = (
        df.select("id", "vec", F.explode(drawn).alias("tree"))
        .withColumn("r", F.row_number().over(per_tree))
        .where(F.col("r") <= tree_rows)
        .select("tree", "id", "vec")
    )

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = _stack(group.sort_values("id")["vec"])
        limit = int(np.ceil(np.log2(max(2, len(rows)))))
        nodes = _grow(rows, np.random.default_rng([seed, int(key[0])]), limit)
        table = pd.DataFrame(nodes, columns=["feature", "cut", "left_node", "right_node", "depth"])
        table.insert(0, "node", range(len(table)))
        table.insert(0, "tree", int(key[0]))
        table["rows"] = len(rows)
        return table

    schema = "tree int, node int, feature int, cut double, left_node int, right_node int, depth double, rows int"
    forest = samples.groupBy("tree").applyInPandas(fit, schema).toPandas()  # trees × tree rows nodes
    parts = [
        tuple(part.sort_values("node")[c].to_numpy() for c in ("feature", "cut", "left_node", "right_node", "depth"))
        for _, part in forest.groupby("tree")
    ]
    expected = _average_path(float(forest["rows"].max()) if len(forest) else 1.0) or 1.0
    shared = spark.sparkContext.broadcast(parts)

    def score(batches):
        for batch in batches:
            if len(batch) == 0:
                continue
            rows = _stack(batch["vec"])
            depth = np.zeros(len(rows))
            for feature, cut, left, right, leaf_depth in shared.value:
                at = np.zeros(len(rows), dtype=int)
                while True:
                    split = feature[at]
                    inner = np.nonzero(split >= 0)[0]
                    if len(inner) == 0:
                        break
                    here = at[inner]
                    goes_left = rows[inner, split[inner]] <= cut[here]
                    at[inner] = np.where(goes_left, left[here], right[here])
                depth += leaf_depth[at]
            mean = depth / max(1, len(shared.value))
            yield pd.DataFrame({"id": batch["id"], "score": np.power(2.0, -mean / expected)})

    scored = df.select("id", "vec").mapInPandas(score, "id bigint, score double")
    return flag_share(scored, "score", contamination)


def anomaly_summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count("*").alias("rows"),
        F.count_if("is_outlier").alias("anomalies"),
        rounded(F.avg(F.col("is_outlier").cast("double"))).alias("anomaly_ratio"),
    )


def pca_2d(df: DataFrame) -> DataFrame:
    """(id, x, y): first two components of centred vectors, signs fixed so that
    the largest loading is positive."""
    vectors = df.select("id", array_to_vector("vec").alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="c", withMean=True, withStd=False).fit(vectors)
    shifted = centred.transform(vectors)
    model = PCA(k=2, inputCol="c", outputCol="p").fit(shifted)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = vector_to_array("p")
    return model.transform(shifted).select(
        "id", rounded(out[0] * signs[0], 6).alias("x"), rounded(out[1] * signs[1], 6).alias("y")
    )


def projection_points(df: DataFrame, n: int = 500) -> DataFrame:
    """Evenly spaced points of the 2-D projection with their label."""
    projected = pca_2d(df).join(df.select("id", "label"), "id")
    return evenly_spaced(projected, n, ["id"]).drop("_pos")


@dataclass
class GroupingRun:
    """Results of several clustering or anomaly models over one prepared table."""

    results: DataFrame  # (model, status, error, metric, value)
    labels: dict[str, DataFrame]  # (id, label), or (id, score, is_outlier)
    projection: DataFrame  # (id, x, y)
    names: list[str]


def _cluster(name: str, points: DataFrame, options: dict) -> tuple[DataFrame, dict[str, float]]:
    if name == "kmeans":
        labels, facts = kmeans(points, options["n_clusters"], options["seed"])
        extra = {"inertia": facts.first()["inertia"]}
    elif name == "dbscan":
        labels, extra = dbscan(points, options["eps"], options["min_samples"]), {}
    else:
        raise ValueError(f"unknown clustering model: {name}")
    labels = cut_lineage(labels)
    whole = points.join(labels, "id")
    row = cluster_profile(labels).first().asDict()
    found = {k: v for k, v in row.items() if isinstance(v, (int, float))}
    for measure in (silhouette_squared, davies_bouldin):
        first = measure(whole.where("label >= 0")).first()
        found |= {k: v for k, v in (first.asDict() if first else {}).items() if isinstance(v, (int, float))}
    return labels, {**found, **extra}


def _anomalies(name: str, points: DataFrame, options: dict) -> tuple[DataFrame, dict[str, float]]:
    if name == "isolation_forest":
        flagged = isolation_forest(points, options["contamination"], seed=options["seed"])
    elif name == "local_outlier_factor":
        flagged = local_outlier_factor(points, options["n_neighbors"], options["contamination"])
    else:
        raise ValueError(f"unknown anomaly model: {name}")
    flagged = cut_lineage(flagged)
    return flagged, {k: float(v) for k, v in anomaly_summary(flagged).first().asDict().items() if v is not None}


def grouping_run(
    df: DataFrame, models: Sequence[str], config: FeatureConfig, key: str, n_clusters: int = 3, eps: float = 0.5,
    min_samples: int = 5, contamination: float = 0.1, n_neighbors: int = 20, seed: int = 42,
) -> GroupingRun:
    """Select and preprocess columns, fit every model, measure it and project the rows.

    ``key`` is a unique whole number; a failing model is only a row of the results.
    """
    prepared = build_preprocessor(config).fit(df).transform(df)
    names = feature_names(prepared)
    points = cut_lineage(
        prepared.select(quoted(key).cast("bigint").alias("id"), vector_to_array("features").alias("vec"))
    )
    options = {"n_clusters": n_clusters, "eps": eps, "min_samples": min_samples, "contamination": contamination,
               "n_neighbors": n_neighbors, "seed": seed}
    rows, labels = [], {}
    for name in models:
        try:
            fit = _anomalies if name in ("isolation_forest", "local_outlier_factor") else _cluster
            labels[name], found = fit(name, points, options)
            rows += [(name, "trained", None, metric, float(value)) for metric, value in found.items()]
        except Exception as error:  # keep the other models
            rows.append((name, "failed", str(error)[:500], None, None))
    schema = "model string, status string, error string, metric string, value double"
    return GroupingRun(df.sparkSession.createDataFrame(rows, schema), labels, pca_2d(points), names)
