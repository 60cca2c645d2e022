"""Components of documents under the Jaccard similarity of their word n-gram sets, by prefix trees.

Only components are computed. There is no join output, neither pairs nor a number of links: walks leave out sets that are
connected already.

A document's set are its distinct n-grams as 64-bit hashes. Documents of equal sets are one class. The others are brought
together without comparing pairs: the hash range is cut into more parts than two similar sets can differ in, so they agree in
one part whole; each part signs. The sets that share a signature with a set of smaller id than all others that have it are that
set's cluster, so two sets that share a signature meet in a cluster, however many of the others are unlike them. Part numbers depend on the size and
the limit, so sizes fall into bands and a set signs as well for every lower band that a similar set can lie in. Parts that are
empty sign nothing. There are as many parts more as a set of the band is likely to leave empty, so one of the parts in which
similar sets agree has n-grams if either set has no more empty parts than that; a set that has signs again under other hashes.

The sets of a cluster are ordered by frequency in it and stored in a prefix tree whose nodes hold a stride of n-grams. A set
walks the tree level by level: the overlap with a node is computed once for all sets below it, and a subtree is left when the
overlap so far and what can still come, on either side, stay under the least overlap of any set below. Sets that are already
connected need no comparison, so a walk enters only subtrees with sets of other components.

Clusters of more than ``BLOCK`` sets or ``BLOCK_GRAMS`` n-grams are split: blocks with the cluster's first set in each are
joined on their own; then the sets outside the largest component, in blocks as well, walk the trees of all blocks, one task
per pair of blocks. No link between different components is lost, a task holds two blocks at most, and a group of near copies
of any size costs work in proportion to it.

Results: null texts and texts without words have an empty set and link with nothing. Rows of equal id are one node. A null
id links with nothing and has no component. Repeated rows are equal sets. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import fresh, written, written_for_now
from tallyloom.llm.arrow import documents, parts, record
from tallyloom.llm.components import components
from tallyloom.operators.text_index import code_filter, may_be_in

#: Words of an n-gram; links have 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 3, 90
#: Sets of a block, and n-grams of all its sets together.
BLOCK, BLOCK_GRAMS = 2000, 1 << 20
#: Upper end of the first size band, and the ratio of the others.
FIRST_BAND, BAND_RATIO = 2, 1.6
#: Hashes under which a set with empty parts may sign; under the last, empty parts sign too.
_SCHEMES = 4
#: Kinds of signatures at most (bands times schemes), a power of two.
_KINDS = 256
#: N-grams of a node of the prefix tree at least, and levels at most.
_STRIDE, _LEVELS = 16, 24
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xE9846AF9B1A615D5)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def ngram_sets(texts: list[bytes], width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; ASCII letters are lowered, fewer words than ``width`` are one n-gram."""
    known: dict[bytes, int] = {}
    out = []
    for text in texts:
        words = text.lower().split()
        if len(words) < width:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64))
            continue
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        hashes = one[: len(one) - width + 1].copy()
        for k in range(1, width):
            hashes = hashes * _U(0x9E3779B97F4A7C15) + one[k : len(one) - width + 1 + k]
        out.append(np.unique(_mix(hashes)))
    return out


def _bands(size: int, percent: int = PERCENT) -> list[tuple[int, int, int, int]]:
    """Bands that a set of this size signs for, its own first: number of the band, upper end, number of parts, and parts that
    may be empty."""
    highs = [FIRST_BAND]
    while size >= highs[-1]:
        highs.append(int(highs[-1] * BAND_RATIO))
    # the smaller of two similar sets has percent of the larger at least, and they differ in fewer than count n-grams
    mine = [(k, h) for k, h in enumerate(highs) if k == len(highs) - 1 or percent * size <= 100 * (h - 1)]
    out = []
    for k, h in reversed(mine):
        count = (h - 1) * (100 - percent) // percent + 1
        spare = math.ceil(1.2 * count * math.exp(-h / (BAND_RATIO * count))) if count > 1 else 0
        out.append((k, h, count + spare, spare))
    return out


def signed(hashes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the parts of a sorted set, and for each kind of them (band and scheme, the lowest bits of a signature) how
    many of its own a set surely shares with any similar set that it meets there.

    Sets of at least this similarity share a signature: in the first scheme in which either leaves few enough parts empty, all
    parts in which they agree but those that are empty. Each n-gram in which they differ changes one part, so that is as many
    as either has filled parts, at most less the n-grams in which they can differ; and one of the two fills ``count - spare`` at
    least there, or both sign empty parts too. That is more than one for most sets, so a set that shares fewer shares them by
    chance.
    """
    out, kinds, sure, n = [], [], [], len(hashes)
    for band, high, count, spare in _bands(n, percent) if n else []:
        # the most n-grams in which this set and a similar one can differ that meet in this band, where the smaller is below high
        most = min(n, high - 1) * (100 - percent) // percent
        most = most if n < high else min(most, (n + high - 1) * (100 - percent) // (100 + percent))
        for scheme in range(_SCHEMES):
            x = hashes if scheme == 0 else np.sort(_mix(hashes + _U(scheme)))
            part = ((x >> _U(32)) * _U(count)) >> _U(32)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            kind, salt = band * _SCHEMES + scheme, _U(high) << _U(36) | _U(scheme) << _U(32)
            found = [_mix(np.add.reduceat(_mix(x), starts) + _mix(salt | part[starts]))]
            few = count - len(starts) <= spare
            if not few and scheme == _SCHEMES - 1:
                empty = np.setdiff1d(np.arange(count, dtype=np.uint64), part[starts])
                found.append(_mix(_mix(salt | empty)))
            out += [(f & ~_U(_KINDS - 1)) | _U(kind) for f in found]
            kinds.append(kind)
            sure.append(max(1, len(starts) - most, count - spare - most))
            if few:
                break
    flat = np.concatenate(out) if out else np.empty(0, np.uint64)
    return flat, np.array(kinds, np.int32), np.array(sure, np.int32)


def signatures(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return signed(hashes, percent)[0]


def _signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A table (id, text) as (id, size, a, b, kinds, sure, signatures); a and b are the digest of the set."""
    def lists(values: list[np.ndarray], kind: str) -> pa.Array:
        offsets = np.cumsum([0, *map(len, values)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*values, np.empty(0, kind)]).astype(kind)))

    def sign(batches):
        for batch in parts(batches, "text"):
            sets = ngram_sets(documents(batch.column("text")), width)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            found = [signed(s, percent) for s in sets]
            yield record({
                "id": batch.column("id"), "size": pa.array([len(s) for s in sets], pa.int64()),
                "a": pa.array(digests[:, 0]), "b": pa.array(digests[:, 1]), "kinds": lists([f[1] for f in found], "i4"),
                "sure": lists([f[2] for f in found], "i4"), "signatures": lists([f[0].view(np.int64) for f in found], "i8"),
            })

    return docs.mapInArrow(sign, "id long, size long, a long, b long, kinds array<int>, sure array<int>, signatures array<long>")


def _members(signs: DataFrame, of_row: DataFrame) -> DataFrame:
    """(id, component): sets that may have a similar one, by the smallest id that shares a signature with them.

    One shuffle of the signatures: each row sees the smallest id that has its signature, and whether another has it, row by row
    in order of ids. Equal sets have equal signatures, so the smallest is a class's own; the other members of classes go
    afterwards, from shared signatures only.

    The clusters of a set and kind are put in one order for all sets, the larger first, and the last ones go as long as their
    signatures together are fewer than the set surely shares with any similar set. Of the clusters in which two similar sets
    share signatures neither can lose the first: all that they share lies there and behind. So they still meet, a set that
    shares too few by chance has no cluster, and one in a group of near copies is in few of the group's clusters.
    """
    each = signs.select("id", F.explode("signatures").alias("signature"))
    order = Window.partitionBy("signature").orderBy("id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.select("id", "signature", F.first("id").over(so_far).alias("component"), F.lead("id").over(order).alias("next"))
    each = each.filter("id <> component or next is not null").select("id", "component", F.col("signature").bitwiseAND(_KINDS - 1).cast("int").alias("kind"))
    reps = of_row.filter("id = rep").select("id")
    shared = written(each.groupBy("id", "component", "kind").agg(F.count("*").alias("n")), "shared").join(reps, "id", "left_semi")
    large = shared.groupBy("component").agg(F.sum("n").alias("weight"))
    sure = signs.select("id", F.explode(F.arrays_zip("kinds", "sure")).alias("k")).select("id", F.col("k.kinds").alias("kind"), F.col("k.sure").alias("sure"))
    sure = sure.groupBy("id", "kind").agg(F.min("sure").alias("sure"))  # an id may have several sets
    last = Window.partitionBy("id", "kind").orderBy(F.desc("weight"), "component").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = shared.join(large, "component").join(sure, ["id", "kind"]).withColumn("left", F.sum("n").over(last))
    return left.filter("left >= sure").select("id", "component").distinct()


def _may_be(ids: DataFrame, id_col: str):
    """Whether a value (long) falls in a slot of one of the ids, found in the tasks that read it by a filter of fixed size."""
    wanted = code_filter(ids, id_col)

    @F.arrow_udf("boolean")
    def some(values: pa.Array) -> pa.Array:
        return pa.array(may_be_in(wanted, values.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)))

    return some


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (id, text) whose id may be one of the ids, so that a join with the ids ships few texts where they are few."""
    return rows.filter("id is not null").filter(_may_be(ids, "id")("id"))


class Tree:
    """Prefix tree of sets: each level's nodes hold the next stride of ordered n-grams."""

    def __init__(self, sets: list[np.ndarray], least_percent: int) -> None:
        self.percent, self.sizes = least_percent, np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        self.grams, where, frequency = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(self.grams), np.int64)
        rank[np.lexsort((self.grams, -frequency))] = np.arange(len(self.grams))
        ends = np.cumsum(self.sizes)
        self.sets = [np.sort(rank[where[e - n : e]]).astype(np.int32) for e, n in zip(ends, self.sizes)]
        longest = int(self.sizes.max())
        self.stride = max(_STRIDE, -(-longest // _LEVELS))
        self.depth = -(-longest // self.stride)
        self.paths, self.tokens, self.parents = [], [], []
        path = np.zeros(len(sets), np.int32)
        for level in range(self.depth):
            low = level * self.stride
            going = np.flatnonzero(self.sizes > low)  # the others ended in a node above
            # past its end a set is filled with a rank that no set asks for
            stride = np.full((len(going), self.stride + 1), len(self.grams), np.int32)
            stride[:, 0] = path[going]
            for row, k in enumerate(going.tolist()):
                piece = self.sets[k][low : low + self.stride]
                stride[row, 1 : len(piece) + 1] = piece
            rows = stride.view(np.dtype((np.void, stride.dtype.itemsize * stride.shape[1]))).ravel()
            _, first, place = np.unique(rows, return_index=True, return_inverse=True)
            path = np.zeros(len(sets), np.int32)
            path[going] = place
            self.paths.append(path)
            self.tokens.append(stride[first, 1:])
            self.parents.append(stride[first, 0])

    def least(self, size: int, others: np.ndarray) -> np.ndarray:
        """Least intersection of a set of this size with sets of other sizes."""
        return -(-self.percent * (size + others) // (100 + self.percent))

    def linked(self, k: int, wanted: np.ndarray) -> np.ndarray:
        """Which of the wanted sets (places) link with set k."""
        asks, size = self.sets[k], len(self.sets[k])
        mark = np.zeros(len(self.grams) + 1, np.int32)
        mark[asks] = 1
        wanted = wanted[(100 * self.sizes[wanted] >= self.percent * size) & (100 * size >= self.percent * self.sizes[wanted])]
        overlap, found = np.zeros(1, np.int64), []
        for level in range(self.depth):
            if not len(wanted):
                break
            path = self.paths[level][wanted]
            nodes, back = np.unique(path, return_inverse=True)
            below = overlap[self.parents[level][nodes]] + mark[self.tokens[level][nodes]].sum(axis=1)
            overlap = np.zeros(len(self.parents[level]), np.int64)
            overlap[nodes] = below
            # what can still come: the rest of the set below, and the rest of the asking set behind the node; a node
            # without sets that can still make it isn't entered again
            done = (level + 1) * self.stride
            rest = np.maximum(self.sizes[wanted] - done, 0)
            behind = size - np.searchsorted(asks, self.tokens[level][nodes, -1], side="right")
            wanted = wanted[below[back] + np.minimum(rest, behind[back]) >= self.least(size, self.sizes[wanted])]
            ended = self.sizes[wanted] <= done  # nothing can come any more, so the bound was the overlap itself
            found.append(wanted[ended])
            wanted = wanted[~ended]
        return np.concatenate([*found, wanted])


def _connect(ids: np.ndarray, sets: list[np.ndarray], percent: int, asks: np.ndarray | None = None, roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest id each is connected to. With ``asks`` only links between a marked set and one that isn't
    count; nodes of equal ``roots`` are connected already, and the roots are the nodes."""
    tree = Tree(sets, percent)
    nodes = ids if roots is None else roots
    names, label = np.unique(nodes, return_inverse=True)
    label = label.copy()
    done = np.zeros(len(ids), bool) if asks is None else ~asks
    while True:
        outside = ~done
        if asks is None:
            outside &= label != np.bincount(label).argmax()
            if not outside.any() or not done.any():
                outside = ~done & (done.any() == outside)  # the first walk may start anywhere
        left = np.flatnonzero(outside)
        if not len(left) or (label == label[0]).all():
            break
        k = int(left[0])
        done[k] = True
        other = label != label[k]
        found = label[tree.linked(k, np.flatnonzero(other if asks is None else other & ~asks))]
        if len(found):
            together = np.append(found, label[k])
            label[np.isin(label, together)] = together.min()
    return nodes, names[label]


def _joined(table: pa.Table, width: int, percent: int) -> pa.Table:
    ids, asks, roots = (table.column(c).to_numpy() for c in ("id", "asks", "root"))
    sets = ngram_sets(documents(table.column("text").combine_chunks()), width)
    nodes, found = _connect(ids, sets, percent, asks, roots) if asks.any() else _connect(ids, sets, percent)
    links = np.unique(np.stack([nodes, found], axis=1)[nodes != found], axis=0)
    return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})


def _blocked(rows: DataFrame, by: str, block: int, block_grams: int, least: int = 1) -> DataFrame:
    """Rows with column size, with the number of blocks and the smallest id of their group, without groups of fewer than
    ``least``. Sets are dealt to blocks by hash, so that a block's sets and n-grams come to the limits on average."""
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum("size").alias("grams"), F.min("id").alias("anchor")).filter(F.col("n") >= least)
    wanted = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("grams") / block_grams)).cast("int")
    return rows.join(sums.select(by, wanted.alias("blocks"), "anchor"), by)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with written_for_now(_signed(base, width, percent), "signed") as signs:
        small = signs.select("id", "size", "a", "b")
        classes = small.filter("id is not null and size > 0").groupBy("a", "b").agg(F.min("id").alias("rep"))
        rep = F.when(F.col("size") > 0, F.col("rep")).otherwise(F.col("id"))
        of_row = written(small.join(classes, ["a", "b"], "left").select("id", "size", rep.alias("rep")), "classes")
        members = _members(signs.filter("id is not null and size > 0"), of_row)
        of_id = small.filter("id is not null").groupBy("id").agg(F.sum("size").alias("size"))
        placed = written(_blocked(members.join(of_id, "id"), "component", block, block_grams, 2), "clusters")
    texts = _only(base, placed).join(placed.select("id", "component", "blocks", "anchor"), "id")

    def joined(rows: DataFrame) -> DataFrame:
        rows = rows.select("id", "text", "component", "ask_at", "at", "asks", "root")
        return written(rows.groupBy("component", "ask_at", "at").applyInArrow(lambda t: _joined(t, width, percent), "a long, b long"), "found")

    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    # the cluster's smallest id stands in every block
    at = F.explode(F.when(F.col("id") == F.col("anchor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own("blocks"))))
    found = joined(texts.select("*", F.lit(0).alias("ask_at"), F.lit(False).alias("asks"), F.col("id").alias("root"), at.alias("at")))
    large = placed.filter("blocks > 1").select("id", "size", "component", "blocks")
    if large.limit(1).count():
        roots = components(found).select(F.col("node").alias("id"), F.col("component").alias("root"))
        rooted = written(large.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
        counted = rooted.groupBy("component", "root").agg(F.count("*").alias("k"))
        main = counted.groupBy("component").agg(F.max(F.struct("k", "root")).alias("top")).select("component", F.col("top.root").alias("main"))
        outside = _blocked(rooted.join(main, "component").filter("root <> main").select("id", "size", "component"), "component", block, block_grams)
        outside = written(outside.select("id", "component", F.col("blocks").alias("ask_blocks")), "outside")
        many = _only(base, large).join(rooted.select("id", "component", "root", "blocks"), "id")
        asking = many.join(outside.select("id", "component", "ask_blocks"), ["id", "component"]).withColumn("asks", F.lit(True)).withColumn("ask_at", own("ask_blocks")).withColumn("at", each("blocks"))
        asked = many.join(outside.select("component", "ask_blocks").distinct(), "component").withColumn("asks", F.lit(False)).withColumn("at", own("blocks")).withColumn("ask_at", each("ask_blocks"))
        found = found.unionAll(joined(asking.unionByName(asked)))
    linked = components(found).withColumnRenamed("node", "rep")
    # an id may stand for several sets, and so belong to several classes
    merged = components(of_row.filter("id is not null and id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).unionAll(
        linked.filter("rep <> component").select(F.col("rep").alias("a"), F.col("component").alias("b"))))
    out = of_row.join(merged.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


#: Ids from here on stand for null ids while one document of each group is chosen.
_UNNAMED = 1 << 62


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that are their component's smallest id, and those without component, with all their columns.

    Rows of equal id and text are one document and one of them stays. A null id counts as an id behind all others, made from
    the text, so documents without id take part and stay where no named one is like them.
    """
    node = fresh(docs, "node")
    unnamed = F.lit(_UNNAMED) + F.pmod(F.xxhash64(text_col), F.lit(_UNNAMED))
    named = docs.withColumn(node, F.coalesce(F.col(id_col).cast("long"), unnamed))
    found = similar_components(named.select(F.col(node).alias("id"), F.col(text_col).alias("text")), "id", "text", width, percent)
    decided = found.groupBy("id").agg(F.count("*").alias("n"), F.max(F.col("id") > F.col("component_id")).alias("later"))
    decided = written(decided.filter("later or n > 1").select(F.col("id").alias(node), "later"), "decided")
    several = decided.filter("not later").select(node)
    # only texts that may be decided about are shipped
    some, few = _may_be(decided, node)(node), _may_be(several, node)(node)
    once = named.filter(~some).unionByName(named.filter(some).join(decided, node, "left_anti").select(named.columns))
    often = named.filter(few).join(several, node, "left_semi").select(named.columns).dropDuplicates([node, text_col])
    return once.unionByName(often).select(docs.columns)
