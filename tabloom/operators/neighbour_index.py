"""Approximate nearest neighbours from several tables of inverted lists.

Every table has its own pivots; a base row stands in the list of its nearest pivot, once per
table.  A query looks into the lists of its nearest pivots in every table and compares exact
distances there.  How many lists that takes is measured, not guessed: for a bounded sample of
queries the exact neighbours are found, and the list of each is ranked among the query's pivots;
the number of lists that reaches the wanted recall on the sample is used for all.

Rows sent are linear in the base (once per table) and in the queries (tables x lists opened).  Lists
that outgrow a block are cut into parts, and a query visits all of them, so nothing is capped.
``knn_join`` in ``neighbours`` is the exact form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.neighbours import (
    BLOCK_ROWS,
    Blocks,
    distances,
    distinct_vectors,
    few_copies,
    knn_join,
    nearest_in_blocks,
    ranked_neighbours,
)
from tabloom.session import cut_lineage

TABLES = 6
LIST_ROWS = 512
LEAST_LISTS, MOST_LISTS = 64, 4096
RECALL = 0.95
SAMPLE_QUERIES = 256


@dataclass
class NeighbourIndex:
    """``lists`` is (a, id, vec) with a = table x width + list; the rest is bounded by tables x lists."""

    pivots: list[np.ndarray]
    width: int
    lists: DataFrame
    sizes: dict[int, int]
    base: DataFrame
    need: int


def _nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    return np.argsort(distances(vectors, pivots), axis=1, kind="stable")[:, :count]


def _draw_pivots(base: DataFrame, tables: int, wanted: int) -> list[np.ndarray]:
    """The vectors of least hash, dealt over the tables: at most ``tables * wanted`` rows."""
    rows = base.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(tables * wanted).collect()
    drawn = [np.array([r["vec"] for r in rows[t::tables]]) for t in range(tables)]
    return [p for p in drawn if len(p)]


def _in_lists(df: DataFrame, pivots: list[np.ndarray], width: int, count: int) -> DataFrame:
    """(a, id, vec): every row once for each of its ``count`` nearest pivots in every table."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = np.stack(batch["vec"].to_numpy())
                for t, centres in enumerate(pivots):
                    near = _nearest_pivots(vectors, centres, count)
                    repeated = batch.loc[batch.index.repeat(near.shape[1]), ["id", "vec"]]
                    yield repeated.assign(a=(t * width + near.ravel()).astype("int32"))[["a", "id", "vec"]]

    return df.select("id", "vec").mapInPandas(place, "a int, id bigint, vec array<double>")


def build_index(
    base: DataFrame, k: int, tables: int = TABLES, list_rows: int = LIST_ROWS, most_lists: int = MOST_LISTS
) -> NeighbourIndex:
    """Index every row of ``base`` (id, vec) for up to ``k`` neighbours.

    No more than ``k + 1`` copies of one vector can be among the answers; only those
    are indexed.  An empty base gives an index without lists.
    """
    few = few_copies(base, k + 1)
    wanted = max(LEAST_LISTS, min(most_lists, few.count() // list_rows))
    pivots = _draw_pivots(base, tables, wanted)
    width = max((len(p) for p in pivots), default=1)
    lists = cut_lineage(_in_lists(few, pivots, width, 1))
    sizes = {r["a"]: r["n"] for r in lists.groupBy("a").agg(F.count("*").alias("n")).collect()}
    return NeighbourIndex(pivots, width, lists, sizes, base, k)


def lists_to_open(
    index: NeighbourIndex, queries: DataFrame, k: int, exclude_self: bool = False, recall: float = RECALL,
    sample: int = SAMPLE_QUERIES,
) -> int:
    """Lists a query must open in every table for this recall, measured on ``sample`` queries.

    An exact neighbour is found once its list is open in any table, so its need is the
    least rank of its list over the tables; the answer is the quantile of these needs.
    """
    some = cut_lineage(queries.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample))
    exact = knn_join(some, index.base, k, exclude_self)
    # At most sample x k pairs.
    pairs = (
        exact.join(F.broadcast(some.toDF("query_id", "q")), "query_id")
        .join(index.base.select(F.col("id").alias("neighbour_id"), F.col("vec").alias("b")), "neighbour_id")
        .select("q", "b").collect()
    )
    if not pairs:
        return 1
    q, b = (np.array([r[side] for r in pairs]) for side in ("q", "b"))
    needs = []
    for centres in index.pivots:
        order = _nearest_pivots(q, centres, len(centres))
        home = _nearest_pivots(b, centres, 1)
        needs.append((order == home).argmax(axis=1) + 1)
    least = np.sort(np.min(needs, axis=0))
    return int(least[min(len(least), int(np.ceil(recall * len(least)))) - 1])


def search(
    index: NeighbourIndex, queries: DataFrame, k: int, exclude_self: bool = False, probes: int | None = None,
    recall: float = RECALL, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, neighbour_id, rank, distance) as ``knn_join``, with about the wanted recall.

    Distances are exact and ties go to the smaller id; a query may get fewer than ``k`` rows only
    if the opened lists hold fewer.
    """
    if k > index.need:
        raise ValueError(f"the index holds copies for {index.need} neighbours, not {k}")
    need = k + 1 if exclude_self else k
    count = probes or lists_to_open(index, queries, k, exclude_self, recall)
    opened = cut_lineage(_in_lists(distinct_vectors(queries), index.pivots, index.width, count))
    asked = {r["a"]: r["n"] for r in opened.groupBy("a").agg(F.count("*").alias("n")).collect()}
    # At most tables x lists rows.
    shape = queries.sparkSession.createDataFrame(
        [(int(a), -(-n // block_rows), -(-index.sizes[a] // block_rows)) for a, n in asked.items() if a in index.sizes]
        or [(-1, 1, 1)],
        "a int, nq int, nb int",
    )

    def cut(df: DataFrame, own: str, own_parts: str, other: str, other_parts: str, seed: int) -> DataFrame:
        return (
            df.join(F.broadcast(shape), "a")
            .withColumn(own, F.pmod(F.xxhash64("id", F.lit(seed)), F.col(own_parts)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1)))
            .select(F.col("a").alias("a"), F.col("qi").alias("qi"), F.col("bj").alias("bj"), "id", "vec")
        )

    blocks = Blocks(cut(opened, "qi", "nq", "bj", "nb", 3), cut(index.lists, "bj", "nb", "qi", "nq", 7))
    found = nearest_in_blocks(blocks, need).groupBy("rep", "neighbour_id").agg(F.min("distance").alias("distance"))
    return ranked_neighbours(found, queries, need, k, exclude_self)


def knn_indexed(
    queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = False, recall: float = RECALL, **shape
) -> DataFrame:
    """Index and search in one call; takes the place of ``knn_join``."""
    return search(build_index(base, k, **shape), queries, k, exclude_self, recall=recall)


def measured_recall(found: DataFrame, exact: DataFrame) -> float | None:
    """Share of the exact neighbours that were found; one as near as the last exact one counts."""
    last = exact.groupBy("query_id").agg(F.max("distance").alias("last"), F.count("*").alias("n"))
    hits = found.join(last, "query_id").where("distance <= last").groupBy("query_id").agg(F.count("*").alias("hits"))
    both = last.join(hits, "query_id", "left")
    return both.agg(F.sum(F.coalesce("hits", F.lit(0))) / F.sum("n")).first()[0]
