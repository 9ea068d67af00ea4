"""Exact nearest-neighbour work on vectors, in bounded blocks.

Points are grouped around pivots; the triangle inequality tells which groups
can matter to each other, and groups are cut into blocks of bounded size.  A
task sees one query block and one base block and returns per-query results
only, so neither a dense region nor a hot group lands in one task, and pairs of
points are never emitted.  A row is sent once per block of the other side, so blocks
grow with the table up to ``BLOCK_CELLS`` numbers; inside a task they are met tile by tile.
Matrix products screen the pairs of a tile with a proven margin, and what the margin
leaves open is decided by plain differences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import cut_lineage

BLOCK_ROWS = 4096
MOST_PIVOTS = 256
SLACK = 1e-5
DIGITS = 6
CHUNK_CELLS = 4_000_000
BLOCK_CELLS = 1 << 20  # numbers of a block's vectors: 8 MB
BLOCKS_A_SIDE = 16
SCREEN_GROUPS = 32
SCREEN_CELLS = 500_000


def points(df: DataFrame, key: str, vector: str, extra: Sequence[str] = ()) -> DataFrame:
    """(id, vec as doubles, extra…)."""
    return df.select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec"), *extra
    )


def distances(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Euclidean distances by plain differences, a slice of queries at a time."""
    result = np.empty((len(queries), len(base)))
    step = max(1, CHUNK_CELLS // max(1, base.size))
    for start in range(0, len(queries), step):
        gap = queries[start : start + step, None, :] - base[None, :, :]
        result[start : start + step] = np.sqrt((gap * gap).sum(axis=2))
    return result


def pair_distances(queries: np.ndarray, base: np.ndarray, qi: np.ndarray, bi: np.ndarray) -> np.ndarray:
    """``distances`` of the listed pairs only, by the same plain differences."""
    result = np.empty(len(qi))
    step = max(1, CHUNK_CELLS // max(1, base.shape[1]))
    for start in range(0, len(qi), step):
        gap = queries[qi[start : start + step]] - base[bi[start : start + step]]
        result[start : start + step] = np.sqrt((gap * gap).sum(axis=1))
    return result


def screened(queries: np.ndarray, base: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, squared distances to all of base, their error bound per query), a tile of queries at a time.

    |q|² + |b|² - 2qb as one matrix product: off by at most the bound from ``distances`` squared.
    Numbers that are not finite, or whose squares are not, get the bound infinity.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        qq, bb = (queries * queries).sum(axis=1), (base * base).sum(axis=1)
        left = np.column_stack([-2.0 * queries, np.ones(len(queries)), qq])
        right = np.column_stack([base, bb, np.ones(len(base))]).T
        slack = (4 * base.shape[1] + 32) * np.finfo(float).eps * (np.sqrt(qq) + np.sqrt(bb.max())) ** 2 + 1e-300
        slack = np.where(np.isfinite(slack), slack, np.inf)
        step = max(1, SCREEN_CELLS // len(base))
        for start in range(0, len(queries), step):
            yield start, left[start : start + step] @ right, slack[start : start + step, None]


def nearest_pairs(queries: np.ndarray, base: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base, distance) of the ``m`` nearest of every query; ties at ``DIGITS`` go to the earlier base row."""
    m, found = min(m, len(base)), []
    for start, squares, slack in screened(queries, base):
        rows = len(squares)
        if np.isfinite(slack).all():
            # The m-th least of the groups' minima is not below the m-th least of all.
            width = len(base) // SCREEN_GROUPS
            some = squares
            if width >= 4 * m:
                some = squares[:, : width * SCREEN_GROUPS].reshape(rows, SCREEN_GROUPS, width).min(axis=1)
            reach = np.partition(some, m - 1, axis=1)[:, m - 1, None]
            limit = (np.sqrt(np.maximum(reach, 0) + slack) + 2.0 * 10.0**-DIGITS) ** 2 + slack
            qi, bi = np.nonzero(squares <= limit)
        else:
            qi, bi = np.divmod(np.arange(rows * len(base)), len(base))
        gaps = np.round(pair_distances(queries[start : start + rows], base, qi, bi), DIGITS)
        order = np.lexsort((bi, gaps, qi))
        qi, bi, gaps = qi[order], bi[order], gaps[order]
        kept = np.arange(len(qi)) - np.searchsorted(qi, qi) < m
        found.append((qi[kept] + start, bi[kept], gaps[kept]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def within(queries: np.ndarray, base: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, which pairs lie within ``eps``), a tile of queries at a time."""
    for start, squares, slack in screened(queries, base):
        band = slack + 8 * np.finfo(float).eps * eps * eps
        near = squares <= eps * eps + band
        unsure = near ^ (squares <= eps * eps - band) if np.isfinite(band).all() else np.ones_like(near)
        qi, bi = np.nonzero(unsure)
        near[qi, bi] = pair_distances(queries[start : start + len(near)], base, qi, bi) <= eps
        yield start, near


@dataclass
class Blocks:
    """Query and base rows keyed by (a, qi, bj): one task per key."""

    queries: DataFrame
    base: DataFrame

    def run(self, function: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        keys = ["a", "qi", "bj"]
        return (
            self.queries.groupBy(*keys).cogroup(self.base.groupBy(*keys)).applyInPandas(function, schema)
        )


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()) if len(series) else np.empty((0, 1))


def _with_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    if len(pivots) == 1:
        return df.withColumn("cell", F.lit(0)).withColumn("gap", F.lit(0.0))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)

    def assign(batches):
        for batch in batches:
            if len(batch) == 0:
                continue
            gaps = distances(_stack(batch["vec"]), pivots)
            batch["cell"] = gaps.argmin(axis=1).astype("int32")
            batch["gap"] = gaps.min(axis=1)
            yield batch

    return cut_lineage(df.mapInPandas(assign, f"{schema}, cell int, gap double"))


def _kth_bounds(base: DataFrame, between: np.ndarray, radius: dict[int, float], k: int) -> dict[int, float]:
    """Upper bound of the k-th neighbour distance of every query of a cell."""
    nearest = Window.partitionBy("cell").orderBy("gap", "id")
    rows = (
        base.select("cell", "gap", "id")
        .withColumn("r", F.row_number().over(nearest))
        .where(F.col("r") <= k)
        .collect()  # at most k rows per pivot
    )
    cells = np.array([r["cell"] for r in rows])
    gaps = np.array([r["gap"] for r in rows])
    bounds = {}
    for a, reach in radius.items():
        upper = np.sort(reach + between[a, cells] + gaps)
        bounds[a] = float(upper[k - 1]) if len(upper) >= k else float("inf")
    return bounds


def pair_blocks(
    queries: DataFrame,
    base: DataFrame,
    k: int | None = None,
    eps: float | None = None,
    block_rows: int = BLOCK_ROWS,
    pivots: int | None = None,
) -> Blocks:
    """Blocks that together hold every pair the question needs.

    ``k``: pairs that can be among the k nearest; ``eps``: pairs within a
    radius; neither: all pairs.
    """
    spark = queries.sparkSession
    size = base.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    count = size["n"]
    # Rows of a block: as many as asked for, more in a large table.
    block_rows = max(block_rows, min(BLOCK_CELLS // max(1, size["d"] or 1), -(-count // BLOCKS_A_SIDE)))
    wanted = pivots or min(MOST_PIVOTS, -(-count // block_rows))
    if (k is None and eps is None) or wanted <= 1 or count == 0:
        centres = np.zeros((1, 1))
    else:
        rows = base.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(wanted).collect()
        centres = np.unique(np.array([r["vec"] for r in rows]), axis=0)
    q = _with_cells(queries, centres)
    b = _with_cells(base, centres)
    q_stats = {r["cell"]: r for r in q.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("u")).collect()}
    b_stats = {r["cell"]: r for r in b.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("u")).collect()}
    single = len(centres) == 1
    between = distances(centres, centres)
    radius = {a: r["u"] for a, r in q_stats.items()}
    if single or (k is None and eps is None):
        limit = dict.fromkeys(radius, float("inf"))
    elif k is not None:
        limit = _kth_bounds(b, between, radius, k)
    else:
        limit = dict.fromkeys(radius, float(eps))
    targets = []
    for a, reach in radius.items():
        for cell, stats in b_stats.items():
            least = float(between[a, cell] - reach - limit[a] - SLACK)
            if stats["u"] >= least:
                targets.append((int(cell), int(a), max(least, -1.0)))
    target_rows = spark.createDataFrame(targets or [(-1, -1, 0.0)], "cell int, a int, least double")
    # At most pivots × pivots rows.
    sent = b.join(F.broadcast(target_rows), "cell").where(F.col("gap") >= F.col("least"))
    sent = sent.drop("cell", "gap", "least")
    if single:
        sizes = {0: count}
    else:
        sizes = {r["a"]: r["n"] for r in sent.groupBy("a").agg(F.count("*").alias("n")).collect()}
    plan = [
        (int(a), int(-(-r["n"] // block_rows)), int(-(-sizes.get(a, 1) // block_rows)))
        for a, r in q_stats.items()
    ]
    shape = F.broadcast(spark.createDataFrame(plan or [(-1, 1, 1)], "a int, nq int, nb int"))
    queries_out = (
        q.withColumnRenamed("cell", "a")
        .drop("gap")
        .join(shape, "a")
        .withColumn("qi", F.pmod(F.xxhash64("id", F.lit(3)), F.col("nq")).cast("int"))
        .withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .drop("nq", "nb")
    )
    base_out = (
        sent.join(shape, "a")
        .withColumn("bj", F.pmod(F.xxhash64("id", F.lit(7)), F.col("nb")).cast("int"))
        .withColumn("qi", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
        .drop("nq", "nb")
    )
    # Fresh column ids: both sides may stem from the same table.
    fresh = base_out.select(*[F.col(c).alias(c) for c in base_out.columns])
    return Blocks(queries_out, fresh)


def distinct_vectors(df: DataFrame) -> DataFrame:
    """(id, vec): the smallest id stands for all copies of a vector."""
    return df.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """(query_id, neighbour_id, rank, distance): the exact k nearest.

    Ties at six decimals go to the smaller id.  Copies of a vector are answered
    once, and no query can need more than k + 1 copies of one base vector, so
    copies beyond the k + 1 smallest ids are left out without changing results.
    """
    need = k + 1 if exclude_self else k
    few = few_copies(base, need)
    blocks = pair_blocks(distinct_vectors(queries), few, k=need, block_rows=block_rows, pivots=pivots)
    return ranked_neighbours(nearest_in_blocks(blocks, need), queries, need, k, exclude_self)


def few_copies(base: DataFrame, most: int) -> DataFrame:
    """(id, vec): of equal vectors the ``most`` smallest ids."""
    first = Window.partitionBy("vec").orderBy("id")
    return (
        base.select("id", "vec")
        .withColumn("r", F.row_number().over(first))
        .where(F.col("r") <= most)
        .drop("r")
    )


def nearest_in_blocks(blocks: Blocks, need: int) -> DataFrame:
    """(rep, neighbour_id, distance): the ``need`` nearest of every query in every block."""

    def nearest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(b) == 0:
            return pd.DataFrame({"rep": [], "neighbour_id": [], "distance": []})
        ids = b["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], _stack(b["vec"])[order]
        qi, bi, gaps = nearest_pairs(_stack(q["vec"]), vectors, need)
        return pd.DataFrame({"rep": q["id"].to_numpy()[qi], "neighbour_id": ids[bi], "distance": gaps})

    return blocks.run(nearest, "rep bigint, neighbour_id bigint, distance double")


def ranked_neighbours(found: DataFrame, queries: DataFrame, need: int, k: int, exclude_self: bool) -> DataFrame:
    """The k best of what the blocks found, for every query by the one that stands for its copies."""
    by_distance = Window.partitionBy("rep").orderBy("distance", "neighbour_id")
    best = (
        found.withColumn("r", F.row_number().over(by_distance))
        .where(F.col("r") <= need)
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))).alias("near"))
    )
    reps = distinct_vectors(queries).withColumnRenamed("id", "rep")
    members = queries.select(F.col("id").alias("query_id"), "vec").join(reps, "vec").drop("vec")
    listed = members.join(best, "rep")
    near = F.filter("near", lambda s: s["neighbour_id"] != F.col("query_id")) if exclude_self else F.col("near")
    return listed.select("query_id", F.posexplode(F.slice(near, 1, k)).alias("p", "s")).select(
        "query_id",
        F.col("s.neighbour_id").alias("neighbour_id"),
        (F.col("p") + 1).cast("int").alias("rank"),
        F.col("s.distance").alias("distance"),
    )


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, join: Callable = knn_join, **blocks) -> DataFrame:
    """Majority label of the k nearest; ties go to the smaller label.

    ``join`` finds the neighbours: exactly, or ``neighbour_index.knn_indexed``.
    """
    near = join(test, train, k, **blocks).join(
        train.select(F.col("id").alias("neighbour_id"), "label"), "neighbour_id"
    )
    votes = near.groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("query_id").agg(
        F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("predicted")
    )


def knn_regress(train: DataFrame, test: DataFrame, k: int = 5, join: Callable = knn_join, **blocks) -> DataFrame:
    near = join(test, train, k, **blocks).join(
        train.select(F.col("id").alias("neighbour_id"), "target"), "neighbour_id"
    )
    return near.groupBy("query_id").agg(F.avg("target").alias("predicted"))


def local_outlier_factor(
    df: DataFrame, k: int = 20, contamination: float = 0.1, join: Callable = knn_join, **blocks
) -> DataFrame:
    """(id, lof, is_outlier) from the k nearest other points."""
    near = cut_lineage(join(df, df, k, exclude_self=True, **blocks))
    reach = near.groupBy("query_id").agg(F.max("distance").alias("k_distance"))
    known = reach.toDF("neighbour_id", "k_distance")
    # Density: inverse of the mean reachability distance.
    density = (
        near.join(known, "neighbour_id")
        .groupBy("query_id")
        .agg((1 / (F.avg(F.greatest("distance", "k_distance")) + 1e-10)).alias("density"))
    )
    theirs = density.toDF("neighbour_id", "their_density")
    factor = (
        near.join(theirs, "neighbour_id")
        .groupBy("query_id")
        .agg(F.avg("their_density").alias("m"))
        .join(density, "query_id")
        .select(F.col("query_id").alias("id"), (F.col("m") / F.col("density")).alias("lof"))
    )
    return flag_share(factor, "lof", contamination)


def flag_share(scored: DataFrame, score: str, contamination: float) -> DataFrame:
    """Mark the rows whose score lies above the (1 − contamination) quantile."""
    from tabloom.plans.quantiles import long_quantiles

    long = scored.select(F.lit("s").alias("column"), F.col(score).alias("value"))
    cut = long_quantiles(long, [1.0 - contamination]).select(F.col("q")[0].alias("_cut"))
    return scored.crossJoin(F.broadcast(cut)).select(
        *scored.columns, (F.col(score) > F.col("_cut")).alias("is_outlier")
    )
