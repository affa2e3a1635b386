"""Exact search by cosine that leaves out the tiles of vectors that cannot hold an answer.

Vectors are packed into tiles of neighbours where they lie. Of a tile, its centre and the largest angle between the
centre and a vector (its spread) are kept apart as a narrow row. No vector of a tile is closer to a query than the
angle between query and centre less the spread. So there are two rounds: each query is scored against its nearest
tiles up to ``k`` vectors, and then against the tiles that can still hold one as close as the last of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.retrieval import DIGITS, SCORED, TILE, TOP_K, meeting, scorer, top_k
from shelfmark.session import durable, small_batches, stored

# A tile of neighbours has at most LEAF_ROWS vectors, a tile of centres or queries PACK_ROWS. SLACK covers
# similarities rounded to DIGITS places and the error of an angle near 0.
LEAF_ROWS = 128
PACK_ROWS = 1024
SLACK = 2.0 / 10**DIGITS
PAIR = "group bigint, tile bigint, q_ids array<bigint>, q_matrix binary"


def _unit(np, values):
    """Rows of length 1, and which rows have a length; the others become zeros."""
    values = values.astype(np.float64)
    length = np.sqrt((values * values).sum(axis=1))
    sound = np.isfinite(length) & (length > 0)
    return np.where(sound[:, None], values, 0.0) / np.where(sound, length, 1.0)[:, None], sound


def _neighbours(np, unit, rows, size):
    """``rows`` cut into parts of at most ``size`` by halving between two far ends."""
    parts, left = [], [rows]
    while left:
        rows = left.pop()
        if len(rows) <= size:
            parts.append(rows)
            continue
        own = unit[rows]
        one = own[np.argmin(own @ own.mean(axis=0))]
        other = own[np.argmin(own @ one)]
        order = np.argsort(own @ (one - other), kind="stable")
        left += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return [rows for rows in parts if len(rows)]


def leaves_of(vectors: DataFrame) -> DataFrame:
    """``tile, group, ids, matrix, n, centre, spread``: the vectors (``group, id, vec``) of a group packed with their
    neighbours, batch by batch, and stored, to be searched many times.

    Vectors without length lie in tiles of their own, with a spread of -1. NULL vectors are left out.
    """
    size = LEAF_ROWS
    small_batches(vectors.sparkSession)

    def pack(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for group, part in pdf.groupby("group", sort=False):
                matrix = np.stack(part["vec"].to_list()).astype(np.float32)
                ids = part["id"].to_numpy()
                unit, sound = _unit(np, matrix)
                rows = []
                for at in _neighbours(np, unit, np.nonzero(sound)[0], size):
                    mean = unit[at].mean(axis=0)
                    centre = (mean if (mean * mean).sum() > 1e-12 else unit[at[0]]).astype(np.float32)
                    # Measured from the centre as it is stored, in single precision.
                    cosines = unit[at] @ _unit(np, centre[None, :])[0][0]
                    spread = np.arccos(np.clip(cosines, -1.0, 1.0)).max()
                    rows.append((group, ids[at], matrix[at].tobytes(), len(at), centre, spread))
                for at in _neighbours(np, unit, np.nonzero(~sound)[0], size):
                    rows.append((group, ids[at], matrix[at].tobytes(), len(at), np.zeros_like(matrix[0]), -1.0))
                yield pd.DataFrame(rows, columns=["group", "ids", "matrix", "n", "centre", "spread"])

    held = vectors.filter(F.col("vec").isNotNull()).select("group", "id", "vec")
    packed = held.mapInPandas(pack, f"{TILE}, n bigint, centre array<float>, spread double")
    # Numbers differ by partition; they are written once with the rows.
    return stored(packed.withColumn("tile", F.monotonically_increasing_id()), "leaves")


def _packed(rows: DataFrame, extra: dict[str, str], most: int = PACK_ROWS) -> DataFrame:
    """``group, id, vec`` packed batch by batch into ``group, ids, matrix`` and an array of each column of ``extra``."""
    names = list(extra)

    def pack(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for group, part in pdf.groupby("group", sort=False):
                for start in range(0, len(part), most):
                    cut = part.iloc[start : start + most]
                    matrix = np.stack(cut["vec"].to_list()).astype(np.float32)
                    row = {"group": [group], "ids": [cut["id"].to_numpy()], "matrix": [matrix.tobytes()]}
                    yield pd.DataFrame(row | {name: [cut[name].to_numpy()] for name in names})

    held = rows.filter(F.col("vec").isNotNull()).select("group", "id", "vec", *names)
    return held.mapInPandas(pack, ", ".join([TILE, *[f"{name} array<{kind}>" for name, kind in extra.items()]]))


def _heads(leaves: DataFrame) -> DataFrame:
    """Tiles of centres, with the numbers of the leaves as ``ids``; the vectors themselves are not read."""
    centres = leaves.select("group", F.col("tile").alias("id"), F.col("centre").alias("vec"), "n", "spread")
    return stored(_packed(centres, {"n": "bigint", "spread": "double"}), "heads")


def _asked(queries: DataFrame, extra: dict[str, str]) -> DataFrame:
    packed = _packed(queries, extra)
    return packed.withColumnRenamed("ids", "q_ids").withColumnRenamed("matrix", "q_matrix")


def _nearest(queries: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """The nearest tiles of each query that hold ``k`` vectors together: ``group, query_id, tile``."""

    def look(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q, sound = _unit(np, np.frombuffer(row.q_matrix, np.float32).reshape(len(row.q_ids), -1))
                centre, _ = _unit(np, np.frombuffer(row.matrix, np.float32).reshape(len(row.ids), -1))
                tiles, n = np.asarray(row.ids), np.asarray(row.n)
                close = np.where(np.asarray(row.spread) >= 0, q @ centre.T, -np.inf)
                order = np.argsort(-close, axis=1, kind="stable")[:, :k]
                before = np.cumsum(n[order], axis=1) - n[order]
                at, place = np.nonzero((before < k) & np.isfinite(np.take_along_axis(close, order, axis=1)) & sound[:, None])
                found = order[at, place]
                yield pd.DataFrame(
                    {"group": row.group, "query_id": np.asarray(row.q_ids)[at], "tile": tiles[found],
                     "close": close[at, found], "n": n[found]}
                )

    looked = meeting(_asked(queries, {}), heads).select("group", "ids", "matrix", "n", "spread", "q_ids", "q_matrix")
    near = looked.mapInPandas(look, "group bigint, query_id bigint, tile bigint, close double, n bigint")
    order = Window.partitionBy("group", "query_id").orderBy(F.col("close").desc(), "tile")
    # A tile has a vector at least, so k tiles are enough; the bound reaches the map side.
    few = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return few.withColumn("before", before).filter(F.col("before") < k).select("group", "query_id", "tile")


def _scored(pairs: DataFrame, leaves: DataFrame, k: int) -> DataFrame:
    held = leaves.select("tile", "group", "ids", "matrix")
    met = pairs.select("tile", "q_ids", "q_matrix").join(held, "tile")
    return met.select("group", "ids", "matrix", "q_ids", "q_matrix").mapInPandas(scorer(k), SCORED)


def _floors(queries: DataFrame, leaves: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """``queries`` with ``floor``: the similarity a tile must be able to reach; minus infinity where fewer than ``k``
    vectors have one."""
    near = _nearest(queries, heads, k).withColumnRenamed("query_id", "id")
    first = near.join(queries, ["group", "id"]).select(F.col("tile").alias("group"), "id", "vec")
    # Packed by tile where the queries lie, so that a tile near to very many of them stays in many rows.
    pairs = _asked(first.sortWithinPartitions("group"), {}).withColumnRenamed("group", "tile")
    best = top_k(_scored(pairs, leaves, k), ["group", "query_id"], k)
    last = best.filter((F.col("rank") == k) & ~F.isnan("similarity")).select(
        "group", F.col("query_id").alias("id"), (F.col("similarity") - SLACK).alias("floor")
    )
    return queries.join(last, ["group", "id"], "left").withColumn(
        "floor", F.coalesce("floor", F.lit(float("-inf")))
    )


def candidates(queries: DataFrame, leaves: DataFrame, k: int = TOP_K) -> DataFrame:
    """``group, tile, q_ids, q_matrix``: the tiles that can hold one of the ``k`` nearest, each with the queries for
    which it can."""
    small_batches(leaves.sparkSession)
    heads = _heads(leaves)
    queries = queries.select("group", "id", "vec").filter(F.col("vec").isNotNull())

    def look(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                matrix = np.frombuffer(row.q_matrix, np.float32).reshape(len(row.q_ids), -1)
                q, _ = _unit(np, matrix)
                centre, _ = _unit(np, np.frombuffer(row.matrix, np.float32).reshape(len(row.ids), -1))
                spread = np.asarray(row.spread)
                angle = np.arccos(np.clip(q @ centre.T, -1.0, 1.0))
                most = np.where(spread >= 0, np.cos(np.maximum(angle - spread, 0.0)), -np.inf)
                wanted = most >= np.asarray(row.floor)[:, None]
                q_ids = np.asarray(row.q_ids)
                for i in np.nonzero(wanted.any(axis=0))[0]:
                    yield pd.DataFrame(
                        {"group": [row.group], "tile": [row.ids[i]], "q_ids": [q_ids[wanted[:, i]]],
                         "q_matrix": [matrix[wanted[:, i]].tobytes()]}
                    )

    asked = _asked(durable(_floors(queries, leaves, heads, k)), {"floor": "double"})
    looked = meeting(asked, heads).select("group", "ids", "matrix", "spread", "q_ids", "q_matrix", "floor")
    return looked.mapInPandas(look, PAIR)


def search_leaves(queries: DataFrame, leaves: DataFrame, k: int = TOP_K) -> DataFrame:
    """As ``nearest_top_k`` over stored leaves."""
    scored = _scored(candidates(queries, leaves, k), leaves, k)
    return top_k(scored, ["group", "query_id"], k).select("group", "query_id", "rank", "id", "similarity")


def nearest_top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    """The rows of ``tile_top_k``, exactly: ``group, query_id, rank, id, similarity``; ids are unique in a group.

    Worth it where vectors lie in clusters: the more they do, the fewer tiles are scored. Where they do not, all
    tiles are, and the two rounds come on top. Centres, one for up to ``LEAF_ROWS`` vectors, meet all queries of
    their group. A query or vector without length has no similarity and comes last in order of ``id``; such a
    query meets all tiles. NULL vectors and queries give no rows, and so do empty tables.
    """
    return search_leaves(queries, leaves_of(vectors), k)
