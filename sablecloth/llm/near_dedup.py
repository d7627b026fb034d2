"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its five-word shingles, lower-cased in A-Z.  Documents
of equal sets are one point.  Every independent tree sends each point down the
path of its minwise token; points that share a path meet in a node.

Round one compares every member of a node with the node's most popular point (the
one whose tokens most points share, which is the original in a group of copies):
one comparison a member, whatever the size of the group.  Round two takes the
nodes that still hold points of different components.  Small ones are compared
exhaustively.  A large one branches again by further minwise tokens if that parts
it, and is compared in blocks if it doesn't, so no pair of a node is given up.  A
pair is handled in the first tree that it shares.  Comparisons are estimates from
256 minwise values; points with a partner that the estimate doesn't rule out go,
with their texts, to the same groups again for the comparison of full sets, which
answers with as many links as connect a group and no more.

Recall: a pair of similarity s misses a tree of depth one with probability 1-s, so
all 16 trees of round one with (1-s)^16, under 1e-13 at s = 0.85, and the eight of
round two with 3e-7; each further level of a large node loses (1-s)^4.  The estimate loses a pair at the threshold with about 1e-6.
At another threshold round two has as many trees, and a level as many branches, as keep those losses.

Defined results: null and empty texts have no shingles and are linked with
nothing; a text of fewer than five words is one shingle; rows of one doc_id are
one node, linked with what any of their texts is linked with; a null doc_id has the
component of its set's other documents or null.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .cluster import forget, written
from .components import components
from .textbytes import U64, column_bytes, hash_spans, keyed_by_row, mix, mix1, padded, shingles, slices, words

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 85
#: Trees, and values of a signature; the first values are the trees' tokens.
TREES, VALUES = 16, 256
#: Standard errors under the threshold at which the estimate rules a pair out.
RULED_OUT_ERRORS = 5
#: Points of a block, which are compared with one another; coordinates by which a larger node
#: branches, and levels; the share of a node that one branch holds at most if branching parts it.
BLOCK, BRANCHES, LEVELS, PARTED = 512, 4, 3, 0.3
#: Trees of round two, which compares what round one left apart.
SECOND_TREES = 8
#: Similarity for which BRANCHES and SECOND_TREES are stated.
STATED_PERCENT = 85
_ODD = np.array([mix1(5000 + k) | 1 for k in range(VALUES)], dtype=U64)
_SECOND = U64(0xA24BAED4963EE407)


def shingle_keys(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Distinct shingles of at most 4,096 rows, the row in the upper twelve bits."""
    starts, ends, first = words(data, off)
    value, row = shingles(hash_spans(padded(data, lower=True), starts, ends), first, SHINGLE_WORDS)
    return keyed_by_row(value, row)[0]


def ruled_out(percent: int) -> float:
    """Estimated similarity below which a pair is ruled out at a threshold."""
    s = percent / 100
    return s - RULED_OUT_ERRORS * math.sqrt(s * (1 - s) / VALUES)


def _as_many(n: int, percent: int) -> int:
    """Independent chances that lose a pair at this threshold as seldom as n do at STATED_PERCENT."""
    if percent >= STATED_PERCENT:
        return n
    return math.ceil(n * math.log(1 - STATED_PERCENT / 100) / math.log(1 - percent / 100))


def _rows(off: np.ndarray) -> Iterator[tuple[int, int]]:
    for i, j in slices(off, 1_000_000):
        for k in range(i, j, 4096):
            yield k, min(j, k + 4096)


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = column_bytes(batch.column("text"))
        total = len(off) - 1
        size, one, two = np.zeros(total, np.int64), np.zeros(total, U64), np.zeros(total, U64)
        tokens, values = np.zeros((total, TREES), U64), np.zeros((total, VALUES - TREES), np.uint8)
        for i, j in _rows(off):
            keys = shingle_keys(data[off[i] : off[j]], off[i : j + 1] - off[i])
            row = np.append(np.searchsorted(keys, np.arange(j - i, dtype=U64) << U64(52)), len(keys))
            n = np.diff(row)
            size[i:j] = n
            some = np.flatnonzero(n)
            if not len(some):
                continue
            h = mix(keys & U64(2**52 - 1))
            begin = row[:-1][some]
            one[i + some] = np.add.reduceat(h, begin)
            two[i + some] = np.add.reduceat(mix(h ^ _SECOND), begin)
            for k in range(VALUES):
                x = h * _ODD[k]
                x ^= x >> U64(32)
                x *= _SECOND
                least = np.minimum.reduceat(x, begin)
                if k < TREES:
                    tokens[i + some, k] = mix(least + U64(k))
                else:
                    values[i + some, k - TREES] = mix(least) >> U64(56)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(size),
                pa.array(one.view(np.int64)),
                pa.array(two.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(total + 1, dtype=np.int32) * TREES), pa.array(tokens.view(np.int64).ravel())),
                pa.array([(tokens[i] >> U64(32)).astype(np.uint32).tobytes() + values[i].tobytes() for i in range(total)], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "k1", "k2", "tokens", "sig"],
        )


def _signatures(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of 32 bits and the other values, of eight."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 4 * TREES + VALUES - TREES)
    return np.ascontiguousarray(rows[:, : 4 * TREES]).view(np.uint32), rows[:, 4 * TREES :]


def _agreement(a: tuple, b: tuple) -> np.ndarray:
    """Share of equal values of rows."""
    return ((a[0] == b[0]).sum(axis=-1) + (a[1] == b[1]).sum(axis=-1)) / VALUES


def _likely_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keep = _agreement(_signatures(batch.column("sig_a")), _signatures(batch.column("sig_b"))) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _with_partner(table: pa.Table, least: float) -> pa.Table:
    """The points of a block that have a partner, of another component, that isn't ruled out."""
    tree, comp, side = (table.column(c).to_numpy() for c in ("tree", "comp", "side"))
    tokens, values = _signatures(table.column("sig"))
    some = np.zeros(len(comp), bool)
    for i in range(len(comp) - 1):
        j = np.flatnonzero((comp[i + 1 :] != comp[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 0))) + i + 1
        if tree[i]:  # a pair that shares an earlier tree has been compared there
            j = j[~(tokens[j, : tree[i]] == tokens[i, : tree[i]]).any(axis=1)]
        near = j[_agreement((tokens[j], values[j]), (tokens[i], values[i])) >= least]
        if len(near):
            some[i] = True
            some[near] = True
    return table.select(["node", "doc", "comp", "side"]).filter(pa.array(some))


def _linked(table: pa.Table, percent: int) -> pa.Table:
    """Links of a block by its full sets: as many as connect what is connected.

    side 0: all with all; 1 and 2: with those of the other side."""
    doc, comp, side = (table.column(c).to_numpy() for c in ("doc", "comp", "side"))
    n = len(doc)
    data, off = column_bytes(table.column("text"))
    keys = [shingle_keys(data[off[i] : off[j]], off[i : j + 1] - off[i]) + (U64(i) << U64(52)) for i, j in _rows(off)]
    keys = np.concatenate(keys)
    row = (keys >> U64(52)).astype(np.int64)
    size = np.bincount(row, minlength=n)
    shared, column, count = np.unique(keys & U64(2**52 - 1), return_inverse=True, return_counts=True)
    both = np.zeros((n, n), np.float32)
    wanted = count > 1
    place = np.cumsum(wanted) - 1
    take = wanted[column]
    row, column = row[take], place[column[take]]
    for lo in range(0, int(wanted.sum()), 4096):
        part = (column >= lo) & (column < lo + 4096)
        x = np.zeros((n, 4096), np.float32)
        x[row[part], column[part] - lo] = 1
        both += x @ x.T
    similar = (100 * both.astype(np.int64) >= percent * (size[:, None] + size[None, :] - both.astype(np.int64))) & (both > 0)
    similar &= (side[:, None] != side[None, :]) | (side[:, None] == 0)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    a, b = [], []
    for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
        u, v = find(int(comp[i])), find(int(comp[j]))
        if u != v:
            root[max(u, v)] = min(u, v)
            a.append(int(doc[i]))
            b.append(int(doc[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _mixed(nodes: DataFrame) -> DataFrame:
    """Rows of nodes that hold more than one component, with the node's size."""
    sizes = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("node", "n")
    return nodes.join(sizes, "node")


def _blocks(rows: DataFrame) -> DataFrame:
    """Points of nodes, dealt to pairs of blocks of about BLOCK points."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select(
        F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"),
        "tree",
        "doc",
        "comp",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )


def _groups(nodes: DataFrame, sigs: DataFrame, branches: int) -> DataFrame:
    """Groups (node, tree, doc, comp, side) that cover all pairs of different components of nodes (node, tree, doc, comp)."""
    done = []
    for level in range(LEVELS + 1):
        live = written(_mixed(nodes), "nodes")
        large = live.filter(F.col("n") > BLOCK)
        if level == LEVELS or large.isEmpty():
            done.append(_blocks(live))
            break
        coordinates = [4 * TREES + branches * level + k for k in range(branches)]
        branch = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.substring("sig", k + 1, 1).alias("v")) for k in coordinates)))
        child = large.join(sigs, "doc").select("node", "tree", "doc", "comp", "n", branch.alias("x")).select("node", "tree", "doc", "comp", "n", F.xxhash64("node", "x.k", "x.v").alias("child"))
        child = written(child, "branches")
        most = child.groupBy("node", "child").agg(F.count("*").alias("c"), F.first("n").alias("n")).groupBy("node").agg(F.max(F.col("c") / F.col("n")).alias("share"))
        parted = most.filter(F.col("share") <= PARTED).select("node")
        done.append(_blocks(live.join(parted, "node", "left_anti")))
        nodes = child.join(parted, "node", "left_semi").select(F.col("child").alias("node"), "tree", "doc", "comp")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _links(groups: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of groups (node, doc, comp, side)."""
    needed = groups.select(F.col("doc").alias("doc_id")).distinct()
    # a sort-merge join at every size: a broadcast that only small inputs get would hide the cost of large ones
    texts = rows.join(needed.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "text")
    return groups.join(texts, "doc").groupBy("node").applyInArrow(lambda table: _linked(table, percent), "a long, b long")


def near_duplicates(docs: DataFrame, similarity_percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; kept: the least of its component.

    Documents whose sets have at least that similarity are linked."""
    least, percent = ruled_out(similarity_percent), similarity_percent
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(rows.mapInArrow(_sign_batches, "doc_id long, n_shingles long, k1 long, k2 long, tokens array<long>, sig binary"), "signed")
    groups = signed.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = written(signed.select("doc_id", "n_shingles", "k1", "k2").join(groups, ["k1", "k2"], "left").select("doc_id", "n_shingles", "rep"), "members")
    reps = members.filter("n_shingles > 0 AND doc_id = rep").select(F.col("rep").alias("doc_id")).distinct()
    points = written(signed.filter("n_shingles > 0").join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "tokens", "sig"), "points")
    forget(signed)
    sigs = points.select("doc", "sig")
    nodes = points.select("doc", F.posexplode("tokens").alias("tree", "node"))
    sizes = nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    live = written(nodes.join(sizes, "node"), "live")

    popular = live.groupBy("doc").agg(F.sum("n").alias("popular"))
    pivots = live.join(popular, "doc").groupBy("node").agg(F.max(F.struct(F.col("popular"), (-F.col("doc")).alias("doc"))).alias("top")).select("node", (-F.col("top.doc")).alias("b"))
    stars = live.join(pivots, "node").select(F.col("doc").alias("a"), "b").filter("a <> b").distinct()
    a, b = (sigs.select(F.col("doc").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    likely = written(stars.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(lambda batches: _likely_batches(batches, least), "a long, b long"), "stars")
    # a pivot's members in groups of a block each, the pivot in every one of them
    spread = likely.join(likely.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "b")
    member = spread.select(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("blocks"))).alias("node"), F.col("a").alias("doc"), F.col("a").alias("comp"), F.lit(1).alias("side"))
    pivot = spread.select("b", "blocks").distinct().select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select(F.xxhash64("b", F.col("k").cast("long")).alias("node"), F.col("b").alias("doc"), F.col("b").alias("comp"), F.lit(2).alias("side"))
    linked = written(_links(member.union(pivot), rows, percent), "links")
    first = written(components(linked), "components")

    of = first.select(F.col("node").alias("doc"), "component")
    labelled = live.filter(F.col("tree") < _as_many(SECOND_TREES, percent)).join(of, "doc", "left").select("node", "tree", "doc", F.coalesce("component", "doc").alias("comp"))
    rest = written(_groups(labelled, sigs, _as_many(BRANCHES, percent)).join(sigs, "doc").groupBy("node").applyInArrow(lambda table: _with_partner(table, least), "node long, doc long, comp long, side int"), "rest")
    forget(live, points)
    if not rest.isEmpty():
        more = written(_links(rest, rows, percent), "links")
        if not more.isEmpty():
            first = written(components(first.select("node", "component").filter("node <> component").union(more)), "components")
    final = first.select(F.col("node").alias("rep"), "component")
    return members.join(final, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component", "rep", "doc_id")).alias("kept")
    )


def deduplicated(docs: DataFrame, similarity_percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The documents without near-duplicates, columns unchanged: of each component
    the document of least doc_id stays, once."""
    judged = written(near_duplicates(docs, similarity_percent), "judged")
    gone = judged.filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    repeated = judged.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])
