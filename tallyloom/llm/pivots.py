"""Near-duplicate embeddings by a pivot-permutation index.

A bounded sample of the vectors serves as pivots. Each vector is described by its nearest pivots in order. The inverted list
of a pivot holds all vectors that have it among their nearest; a vector queries the list of its very nearest pivot, counts
the pivots it shares with each vector of the list, and is compared in double precision with those that share enough. Every
vector is indexed and every vector queries. Equal vectors are one class and are indexed once. Long lists are split into
blocks of queries and members, so no task holds a list of any length.

A task passes on one row per vector: its number of links in the block and the smallest vector it is connected to there, not
the links themselves. A pair may be found from both sides; it is counted for a member only if the member's own query, in the
list of its own nearest pivot, doesn't meet the other vector.

Recall against brute force is measured in the tests and in the README. Results: vectors that are null, zero or hold null or
non-finite components link with nothing and are components of their own; so do rows without id, whose component is null.
Vectors of different length don't link. Repeated rows of one id count as vectors of their own. An empty table gives an empty
table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import written
from tallyloom.llm.arrow import record
from tallyloom.llm.components import components

#: Least cosine of a link.
LEAST_COSINE = 0.95
#: Pivots: this many times the root of the number of classes, at most so many. The sample they are taken from has twice as
#: many vectors; one nearer than this cosine to an earlier pivot is passed over, so a dense group has few pivots to itself.
PIVOTS_PER_ROOT, MOST_PIVOTS, APART = 3, 4096, 0.7
#: Nearest pivots that describe a vector, and how many a pair must share.
NEAREST, SHARED = 8, 3
#: Members and queries of a block.
BLOCK = 4096
_STEP = 256


def valid(column: str) -> Column:
    """A vector with finite components, not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow of squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(lists: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    return np.asarray(lists.combine_chunks().flatten() if isinstance(lists, pa.ChunkedArray) else lists.flatten(), np.float64).reshape(rows, -1)


def _apart(sample: np.ndarray, wanted: int) -> np.ndarray:
    """The first ``wanted`` vectors of the sample of which none is near an earlier one."""
    units, open_ = _unit(sample), np.ones(len(sample), bool)
    taken: list[int] = []
    for k in range(len(sample)):
        if open_[k] and len(taken) < wanted:
            taken.append(k)
            open_ &= units @ units[k] < APART
    return sample[taken]


def _described(classes: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """classes (rep, n, vector) with their nearest pivots in order."""
    units = _unit(pivots)

    def describe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                near = _unit(_matrix(piece.column("vector"), piece.num_rows)) @ units.T
                top = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest] if nearest < near.shape[1] else np.argsort(-near, axis=1)
                order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
                top = np.take_along_axis(top, order, 1).astype(np.int32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(top.ravel()), top.shape[1]).cast(pa.list_(pa.int32()))
                yield record({n: piece.column(n) for n in ("rep", "n", "vector")} | {"near": lists})

    return classes.mapInArrow(describe, classes.select("rep", "n", "vector").schema.add("near", T.ArrayType(T.IntegerType())))


def _compare(table: pa.Table, least: float, shared: int, pivots: int) -> pa.Table:
    """Links of the queries of a block to its members: per vector the number of links and the smallest connected vector."""
    asks = table.column("asks").to_numpy()
    rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
    units, near = _unit(_matrix(table.column("vector"), len(rep))), _matrix(table.column("near"), len(rep)).astype(np.int64)
    q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
    used, local = np.unique(near, return_inverse=True)
    local = local.reshape(near.shape)
    has = np.zeros((len(rep), len(used)), np.float32)
    np.put_along_axis(has, local, 1, axis=1)
    ids, place = np.unique(rep, return_inverse=True)
    label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for at in range(0, len(q), _STEP):
        some = q[at : at + _STEP]
        linked = (has[some] @ has[m].T >= shared) & (units[some] @ units[m].T >= least) & (rep[some][:, None] != rep[m][None])
        links_of = linked @ n[m]
        np.add.at(links, place[some], links_of)
        meets_back = has[some][:, local[m, 0]] > 0
        np.add.at(links, place[m], (n[some][:, None] * (linked & ~meets_back)).sum(axis=0))
        for row in np.flatnonzero(links_of):
            together = np.append(label[place[m[linked[row]]]], label[place[some[row]]])
            low = together.min()
            if (together != low).any():
                label[np.isin(label, together)] = low
    kept = (links > 0) | (label != np.arange(len(ids)))
    return pa.table({"rep": ids[kept], "links": links[kept], "root": ids[label[kept]]})


def link_classes(classes: DataFrame, least: float = LEAST_COSINE, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """Block results (rep, links, root) of distinct vectors (rep, n, vector) of one length."""
    total = classes.count()
    wanted = min(MOST_PIVOTS, max(1, math.ceil(PIVOTS_PER_ROOT * math.sqrt(total))))
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(2 * wanted).select("vector").toArrow()
    pivots = _apart(_matrix(sample.column("vector"), sample.num_rows), wanted)
    nearest, shared = min(nearest, len(pivots)), min(shared, len(pivots))
    described = written(_described(classes, pivots, nearest), "described")
    members = described.withColumn("cell", F.explode("near")).withColumn("asks", F.lit(False))
    queries = described.withColumn("cell", F.element_at("near", 1)).withColumn("asks", F.lit(True))
    # the driver gets two counts per pivot
    counts = {(r.cell, r.asks): r.k for r in members.select("cell", "asks").unionAll(queries.select("cell", "asks")).groupBy("cell", "asks").agg(F.count("*").alias("k")).collect()}
    blocks = [[max(1, -(-counts.get((c, asks), 0) // BLOCK)) for c in range(len(pivots))] for asks in (False, True)]
    of = lambda side: F.element_at(F.lit(blocks[side]), F.col("cell") + 1)
    own = lambda side: F.pmod(F.xxhash64("rep"), of(side)).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), of(side) - 1))
    members = members.withColumn("m", own(0)).withColumn("q", every(1))
    queries = queries.withColumn("q", own(1)).withColumn("m", every(0))
    k = len(pivots)
    columns = ["cell", "m", "q", "asks", "rep", "n", "vector", "near"]
    return members.select(columns).unionByName(queries.select(columns)).groupBy("cell", "m", "q").applyInArrow(
        lambda table: _compare(table, least, shared, k), "rep long, links long, root long"
    )


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept (it is its component's smallest)."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    base = base.withColumn("good", valid("vector") & F.col("id").isNotNull())
    classes = written(
        base.filter("good").groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("length", F.size("vector")),
        "classes",
    )
    lengths = [r.length for r in classes.select("length").distinct().collect()]
    found = None
    for length in lengths:
        part = link_classes(classes.filter(F.col("length") == length).drop("length"), least)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "rep long, links long, root long")
    found = written(found, "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "rep"})
    of_class = (
        classes.join(links, "rep", "left").join(roots, "rep", "left")
        .select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    good = base.filter("good").join(of_class, "vector").select("id", "n_links", "component_id")
    alone = base.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionAll(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
