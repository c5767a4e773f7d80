"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are compared within their label only. Each label is cut into shards around centroids, and
every vector joins the shards of its nearest few centroids, so shards overlap. Each shard gets a
graph: the nearest vectors of each vector, robustly pruned, and the edges back. The adjacency lists
of a vector from all its shards are united. Every vector is then searched for in its nearest shard,
with all that the united lists lead to: a greedy search from the medoid finds the closest vectors,
and the range is expanded along edges between vectors that are close enough. Where the range reaches
vectors that belong to other shards, the search goes on there, round after round, until it reaches
no new shard; a vector is counted in the shard it belongs to. Shards whose centroids are as close as
the merging cosine are one. All links are verified by cosine in double precision.

Labels whose audited recall stays low are compared exactly: a vector meets every shard that can hold
one within the threshold.

Identical vectors are one node with a count. A shard with too many vectors is cut into blocks by
hash, each with a graph of its own, and is searched block by block; the vectors searched for come
in slices. So a label or a clump that holds a third of all vectors is many tasks, no link is lost
to a cap, and the counts of the blocks add up. A task returns counts and links that hold its finds
together, never all pairs.

Subramanya et al., "DiskANN" (2019).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.llm.components import components
from textweave.session import materialise


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the sample that centroids are fitted on, ``max_centroids`` their number.

    Every vector is indexed whatever these bounds are. ``block`` bounds the vectors of a graph and
    ``slice`` those searched for in one task. ``near`` is the cosine from which the range is expanded
    and from which united lists bring vectors of other shards in. Centroids with cosine ``merge`` or
    more to an earlier one share its shard. The audit is enlarged from ``audit_rows`` nodes until it
    has seen ``audit_links`` links, or has ``audit_most`` nodes.
    """

    shard: int = 320
    overlap: int = 3
    max_centroids: int = 4096
    fit_rows: int = 65_536
    fit_rounds: int = 6
    candidates: int = 64
    degree: int = 24
    alpha: float = 1.2
    beam: int = 32
    near: float = 0.9
    block: int = 4096
    slice: int = 2048
    audit_rows: int = 256
    merge: float = 0.98
    audit_links: int = 256
    audit_most: int = 4096
    seed: int = 5


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def stacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def robust_pruned(x: np.ndarray, candidates: int, degree: int, alpha: float) -> list[np.ndarray]:
    """Adjacency lists of unit vectors: pruned nearest neighbours, and the edges back."""
    n = len(x)
    c = min(candidates, n - 1)
    if c <= 0:
        return [np.zeros(0, np.int64) for _ in range(n)]
    out = np.full((n, degree), -1, np.int64)
    for start in range(0, n, 256):
        rows = np.arange(start, min(n, start + 256))
        cos = x[rows] @ x.T
        cos[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-cos, c - 1, axis=1)[:, :c]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(cos, near, 1), axis=1, kind="stable"), 1)
        distance = 2 - 2 * np.take_along_axis(cos, near, 1)
        y = x[near]
        between = 2 - 2 * np.matmul(y, y.transpose(0, 2, 1))
        alive = np.ones(near.shape, bool)
        chosen = np.zeros(len(rows), np.int64)
        for j in range(c):  # from the nearest on: keep it, drop what it is close to
            take = np.flatnonzero(alive[:, j] & (chosen < degree))
            out[rows[take], chosen[take]] = near[take, j]
            chosen[take] += 1
            later = alive[take]
            later[:, j + 1 :] &= alpha * alpha * between[take, j, j + 1 :] > distance[take, j + 1 :]
            alive[take] = later
    source = np.repeat(np.arange(n), degree)
    target = out.ravel()
    real = target >= 0
    edges = np.unique(np.r_[source[real] * n + target[real], target[real] * n + source[real]])
    source, target = edges // n, edges % n
    lists = np.split(target, np.searchsorted(source, np.arange(1, n)))
    return [nearest_of(x, i, l, 2 * degree) for i, l in enumerate(lists)]


def nearest_of(x: np.ndarray, i: int, at: np.ndarray, most: int) -> np.ndarray:
    return at if len(at) <= most else at[np.argsort(-(x[at] @ x[i]), kind="stable")[:most]]


class Search:
    """Searches in a graph given as flat adjacency lists."""

    def __init__(self, x: np.ndarray, targets: np.ndarray, sizes: np.ndarray, entry: int) -> None:
        self.x, self.targets, self.entry = x, targets, entry
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def neighbours(self, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, neighbour) for all neighbours of the node of each row."""
        sizes = self.ends[nodes] - self.starts[nodes]
        total = np.cumsum(sizes)
        at = np.repeat(self.starts[nodes] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)
        return np.repeat(rows, sizes), self.targets[at]

    def within(self, queries: np.ndarray, own: np.ndarray, threshold: float, near: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) of all nodes found with cosine >= ``threshold``. ``own`` is the node of each query, or -1."""
        q, n = len(queries), len(self.x)
        seen = np.zeros((q, n), bool)
        cos = np.full((q, beam), -2.0)
        node = np.zeros((q, beam), np.int64)
        open_ = np.zeros((q, beam), bool)
        close: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            new = ~seen[rows, nodes]
            key = np.unique(rows[new] * n + nodes[new])
            rows, nodes = key // n, key % n
            seen[rows, nodes] = True
            c = np.einsum("ij,ij->i", queries[rows], self.x[nodes])
            hit = c >= near
            close.append((rows[hit], nodes[hit], c[hit]))
            return rows, nodes, c

        def into_beams(rows: np.ndarray, nodes: np.ndarray, c: np.ndarray) -> None:
            """Keep the best of each beam; ``rows`` is sorted."""
            if not len(rows):
                return
            touched, first, counts = np.unique(rows, return_index=True, return_counts=True)
            wide = int(counts.max())
            more_c, more_n = np.full((len(touched), wide), -2.0), np.zeros((len(touched), wide), np.int64)
            line = np.repeat(np.arange(len(touched)), counts)
            column = np.arange(len(rows)) - np.repeat(first, counts)
            more_c[line, column], more_n[line, column] = c, nodes
            all_c = np.hstack([cos[touched], more_c])
            best = np.argpartition(-all_c, beam - 1, axis=1)[:, :beam]
            cos[touched] = np.take_along_axis(all_c, best, 1)
            node[touched] = np.take_along_axis(np.hstack([node[touched], more_n]), best, 1)
            open_[touched] = np.take_along_axis(np.hstack([open_[touched], more_c > -2]), best, 1)

        every = np.arange(q)
        into_beams(*visit(every, np.full(q, self.entry)))
        while open_.any():
            rows = np.flatnonzero(open_.any(axis=1))
            at = np.argmax(np.where(open_[rows], cos[rows], -3), axis=1)
            open_[rows, at] = False
            into_beams(*visit(*self.neighbours(rows, node[rows, at])))
        known = own >= 0
        visit(every[known], own[known])
        done = 0
        while done < len(close):
            rows, nodes, _ = close[done]
            done += 1
            if len(rows):
                visit(*self.neighbours(rows, nodes))
        rows, nodes, c = (np.concatenate(part) for part in zip(*close, strict=True))
        hit = c >= threshold
        return rows[hit], nodes[hit]


def tied(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest that ties the same as the links (a, b): each node with the least one it is tied to."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, least[i], low)
        np.minimum.at(new, least[j], low)
        new = new[new]
        if (new == least).all():
            keep = least != np.arange(len(nodes))
            return nodes[keep], nodes[least[keep]]
        least = new


def nodes_of(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """``(label, node, vector, copies)`` of the different usable vectors of each label, as packed unit doubles."""
    usable = vectors.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(label_column).cast("string").alias("label"),
        F.transform(vector_column, lambda v: v.cast("double") + F.lit(0.0)).alias("v"),
    ).filter(
        "id is not null and label is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))"
        " and exists(v, x -> x <> 0)"
    )

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            units = []
            for v in frame["v"]:
                v = np.asarray(v, np.float64)
                v = v / np.abs(v).max()
                units.append((v / np.sqrt((v * v).sum())).tobytes())
            yield frame[["label", "node", "copies"]].assign(vector=units)

    different = usable.groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    # Vectors of different lengths have no cosine: the length is part of the label from here on.
    labelled = different.withColumn("label", F.concat("label", F.lit("/"), F.size("v")))
    return labelled.mapInPandas(packed, "label string, node bigint, copies bigint, vector binary")


def centroids(spark: SparkSession, nodes: DataFrame, settings: Settings) -> dict[str, np.ndarray]:
    """Centroids of the labels with enough vectors for two shards; at most ``max_centroids`` in all."""
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * settings.shard)
    total = sizes.agg(F.sum(F.floor(F.col("n") / settings.shard))).first()[0] or 0
    per = settings.shard * max(1.0, total / settings.max_centroids)
    large = sizes.withColumn("k", F.floor(F.col("n") / per).cast("int")).filter("k > 1")
    rows = settings.fit_rows / max(1, min(total, settings.max_centroids))
    share = F.least(F.lit(1.0), F.col("k") * rows / F.col("n"))
    chance = F.pmod(F.xxhash64("node", F.lit(settings.seed)), F.lit(1 << 20)) / (1 << 20)
    sample = nodes.join(large.hint("merge"), "label").filter(chance < share).select("label", "k", "node", "vector")

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        k = min(int(part["k"].iloc[0]), len(part))
        return pd.DataFrame({"label": [part["label"].iloc[0]], "centres": [k_means(stacked(part["vector"]), k, settings.fit_rounds, settings.seed).tobytes()], "k": [k]})

    found = sample.groupBy("label").applyInPandas(fitted, "label string, centres binary, k int").collect()
    return {r["label"]: np.frombuffer(r["centres"], np.float64).reshape(r["k"], -1) for r in found}


def leaders(centres: np.ndarray, merge: float) -> np.ndarray:
    """For each centroid the first one that it is merged into. Merged ones lie around one centroid, they form no chains."""
    leader = np.full(len(centres), -1)
    for i in range(len(centres)):
        if leader[i] < 0:
            leader[(leader < 0) & (centres @ centres[i] >= merge)] = i
            leader[i] = i
    return leader


def memberships(nodes: DataFrame, centres: dict[str, np.ndarray], settings: Settings) -> DataFrame:
    """``(label, shard, node, copies, vector, primary, home)``: each node in its nearest shards; ``home`` is the nearest."""
    leader = {label: leaders(c, settings.merge) for label, c in centres.items()}

    def assigned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for label, part in frame.groupby("label", sort=False):
                if label not in centres:
                    yield part.assign(shard=0, primary=True, home=0)
                    continue
                c = centres[label]
                k = min(settings.overlap, len(c))
                order = np.argsort(-(stacked(part["vector"]) @ c.T), axis=1, kind="stable")[:, :k]
                shard = leader[label][order]
                for j in range(k):
                    new = (shard[:, :j] != shard[:, j : j + 1]).all(axis=1)
                    yield part[new].assign(shard=shard[new, j], primary=j == 0, home=shard[new, 0])

    return nodes.mapInPandas(assigned, "label string, node bigint, copies bigint, vector binary, shard int, primary boolean, home int")


def dealt(around: DataFrame, asked: DataFrame, blocks: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """``around`` for each slice of the queries of its shard, and ``asked`` for each block of the shard asked."""
    shards = ["label", "shard"]
    searched = F.floor(F.count("*") / settings.slice).cast("int")
    slices = asked.groupBy(*shards).agg((searched + 1).alias("slices"))
    there = around.join(slices, shards).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    sent = (
        asked.join(slices, shards)
        .join(blocks, shards)
        .withColumn("slice", F.pmod(F.xxhash64("node", F.lit(settings.seed + 2)), F.col("slices")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    return there, sent.select(*[F.col(c).alias(c) for c in (*shards, "block", "slice", "node", "vector")])


KEYS = ["label", "shard", "block", "slice"]
FINDS = "node bigint, found bigint, tied bigint, label string, shard int"


def finds(wanted: np.ndarray, count: np.ndarray, ties: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Counts, and links that tie the same as all ``ties``."""
    a, b = tied(*(np.concatenate(part) for part in zip(*ties, strict=True)))
    counted = pd.DataFrame({"node": wanted[count > 0], "found": count[count > 0]})
    return pd.concat([counted, pd.DataFrame({"node": a, "tied": b})], ignore_index=True)


def framed(label: str, parts: list[pd.DataFrame]) -> pd.DataFrame:
    frame = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
    frame = frame.reindex(columns=["node", "found", "tied", "shard"]).astype("Int64")
    frame.insert(3, "label", label)
    return frame


def blocks_of(members: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The number of blocks of each shard, and the members with theirs."""
    sizes = members.groupBy("label", "shard").agg(F.ceil(F.count("*") / settings.block).cast("int").alias("blocks"))
    return sizes, members.join(sizes, ["label", "shard"]).withColumn("block", block_by_hash(settings))


def block_by_hash(settings: Settings) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(settings.seed + 1)), F.col("blocks")).cast("int")


def link_counts(nodes: DataFrame, threshold: float, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """``(node, found)``, the linked rows of other nodes, and links ``(a, b)`` that tie what is linked."""
    shards = ["label", "shard"]
    members = memberships(nodes, centroids(nodes.sparkSession, nodes, settings), settings)
    members = materialise(members, "memberships")
    home = members.filter("primary").select(*shards, "node", "copies", "vector", "home")
    blocks, members = blocks_of(members, settings)

    def built(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node").reset_index(drop=True)
        x, node = stacked(part["vector"]), part["node"].to_numpy()
        lists = robust_pruned(x, settings.candidates, settings.degree, settings.alpha)
        return pd.DataFrame({"node": node, "to": [node[l] for l in lists], "cos": [x[l] @ v for l, v in zip(lists, x, strict=True)]})

    graph = members.select(*shards, "block", "node", "vector").groupBy(*shards, "block").applyInPandas(
        built, "node bigint, to array<bigint>, cos array<double>"
    )
    # At most twice the degree from each of a few shards.
    edge = F.explode(F.arrays_zip("to", "cos")).alias("edge")
    united = graph.select("node", edge).select("node", "edge.to", "edge.cos").distinct()
    united = materialise(united.groupBy("node").agg(F.collect_list(F.struct("to", "cos")).alias("edges")), "graph")

    # What the united lists of a shard lead to, near enough to matter for the range, joins the shard.
    own = members.select(*shards, "blocks", "node")
    reached = (
        own.join(united.hint("merge"), "node")
        .select(*shards, "blocks", F.explode(F.filter("edges", lambda e: e["cos"] >= settings.near)).alias("edge"))
        .select(*shards, "blocks", F.col("edge.to").alias("node"))
        .distinct()
        .join(own.select(*shards, "node").hint("merge"), [*shards, "node"], "left_anti")
        .withColumn("block", block_by_hash(settings))
        .join(home.select("node", "copies", "vector", "home").hint("merge"), "node")
    )
    columns = [*shards, "block", "node", "copies", "vector", "home"]
    around = members.select(*columns).union(reached.select(*columns))
    around = materialise(around.join(united.hint("merge"), "node", "left"), "shards")
    reach = min(threshold, settings.near)

    def found(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if graph.empty or queries.empty:
            return framed("", [])
        label, shard = graph["label"].iloc[0], graph["shard"].iloc[0]
        graph, queries = graph.sort_values("node"), queries.sort_values("node")
        node, x = graph["node"].to_numpy(), stacked(graph["vector"])
        sizes, targets = [], []
        for edges in graph["edges"]:
            to = np.array([e["to"] for e in edges], np.int64) if edges is not None else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(node, to), len(node) - 1)
            targets.append(at[node[at] == to])
            sizes.append(len(targets[-1]))
        medoid = int(np.argmax(x @ x.mean(axis=0)))
        search = Search(x, np.concatenate(targets).astype(np.int64), np.array(sizes, np.int64), medoid)
        copies, homes = graph["copies"].to_numpy(), graph["home"].to_numpy()
        wanted, vectors = queries["node"].to_numpy(), stacked(queries["vector"])
        count, ties, further = np.zeros(len(wanted), np.int64), [], []
        for start in range(0, len(wanted), 256):
            q, v = wanted[start : start + 256], vectors[start : start + 256]
            own = np.minimum(np.searchsorted(node, q), len(node) - 1)
            own = np.where(node[own] == q, own, -1)
            r, n = search.within(v, own, reach, reach, settings.beam)
            elsewhere = homes[n] != shard
            pairs = np.unique(np.c_[q[r[elsewhere]], homes[n[elsewhere]]], axis=0)
            further.append(pd.DataFrame({"node": pairs[:, 0], "shard": pairs[:, 1]}))
            hit = ~elsewhere & (node[n] != q[r])
            r, n = r[hit], n[hit]
            hit = np.einsum("ij,ij->i", v[r], x[n]) >= threshold
            r, n = r[hit], n[hit]
            count[start : start + 256] = np.bincount(r, copies[n], minlength=len(q))
            ties.append(tied(q[r], node[n]))
        return framed(label, [finds(wanted, count, ties), *further])

    # The search goes on in every shard that the range of a vector reaches, until there is no new one.
    asked = home.select(*shards, "node", "vector")
    visited, results = asked.select(*shards, "node"), []
    while True:
        there, sent = dealt(around, asked, blocks, settings)
        result = there.select(*KEYS, "node", "copies", "vector", "home", "edges").groupBy(*KEYS).cogroup(sent.groupBy(*KEYS)).applyInPandas(found, FINDS)
        result = materialise(result, "finds")
        results.append(result)
        further = result.filter("shard is not null").select(*shards, "node").distinct()
        further = materialise(further.join(visited.hint("merge"), [*shards, "node"], "left_anti"), "further")
        if further.isEmpty():
            break
        visited = visited.union(further)
        asked = further.join(home.select("node", "vector").hint("merge"), "node").select(*shards, "node", "vector")
    return summed(results)


def summed(results: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Counts by node, and links, of all finds."""
    result = reduce(DataFrame.union, results)
    counts = result.filter("found is not null").groupBy("node").agg(F.sum("found").alias("found"))
    return counts, result.filter("tied is not null").select(F.col("node").alias("a"), F.col("tied").alias("b"))


def exact_counts(nodes: DataFrame, threshold: float, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """As ``link_counts``, with every link: all vectors are compared that can be within the threshold.

    A vector y lies in the cell of its nearest centroid c: for any centroid p, y(p - c) <= 0. A vector
    q at a distance of d from y at most has q(p - c) <= d |p - c|. Cells without that are left out.
    """
    settings = replace(settings, shard=settings.block, overlap=1, merge=2.0)
    centres = centroids(nodes.sparkSession, nodes, settings)
    home = materialise(memberships(nodes, centres, settings), "homes").select("label", "shard", "node", "copies", "vector")
    distance = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def sent_to(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for label, part in frame.groupby("label", sort=False):
                if label not in centres:
                    yield part.assign(shard=0)
                    continue
                c = centres[label]
                apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
                for start in range(0, len(part), 512):
                    rows = part.iloc[start : start + 512]
                    cos = stacked(rows["vector"]) @ c.T
                    can = np.ones(cos.shape, bool)
                    for p in np.argsort(-cos, axis=1)[:, :8].T:
                        can &= np.take_along_axis(cos, p[:, None], 1) - cos <= distance * apart[p] + 1e-6
                    row, shard = np.nonzero(can)
                    yield rows.iloc[row].assign(shard=shard)

    asked = home.select("label", "node", "vector").mapInPandas(sent_to, "label string, node bigint, vector binary, shard int")
    asked = materialise(asked, "asked")
    blocks, members = blocks_of(home, settings)
    there, sent = dealt(members, asked, blocks, settings)

    def compared(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if block.empty or queries.empty:
            return framed("", [])
        node, copies, x = block["node"].to_numpy(), block["copies"].to_numpy(), stacked(block["vector"])
        wanted, vectors = queries["node"].to_numpy(), stacked(queries["vector"])
        count, ties = np.zeros(len(wanted), np.int64), []
        for start in range(0, len(wanted), 256):
            q = wanted[start : start + 256]
            r, n = np.nonzero((vectors[start : start + 256] @ x.T >= threshold) & (q[:, None] != node[None, :]))
            count[start : start + 256] = np.bincount(r, copies[n], minlength=len(q))
            ties.append(tied(q[r], node[n]))
        return framed(block["label"].iloc[0], [finds(wanted, count, ties)])

    result = there.select(*KEYS, "node", "copies", "vector").groupBy(*KEYS).cogroup(sent.groupBy(*KEYS)).applyInPandas(compared, FINDS)
    return summed([materialise(result, "compared")])


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    settings: Settings = Settings(),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    least_recall: float = 0.9,
) -> DataFrame:
    """``(id_column, n_links, component_id, kept, audited_recall)`` of every row.

    Rows are linked if their labels are equal and their cosine in double precision reaches
    ``threshold``; no link below it is given, and nearly all others are found. The share found is
    measured (``audit``) and returned, null if the audit met no link. Labels below ``least_recall`` are
    searched once more with wider settings, and compared exactly if they stay below. Rows with a null or zero vector, or a null or non-finite component, or a null label or id, or a
    length of their own, link with nothing. Identical vectors of a label are always linked. Rows
    given twice are linked rows; ids are taken to be unique otherwise. An empty table gives an empty
    result; other columns are not read.
    """
    nodes = materialise(nodes_of(vectors, id_column, vector_column, label_column), "vectors")
    counts, links = link_counts(nodes, threshold, settings)
    true, whole = audit_sample(nodes, counts, threshold, settings)
    wider = replace(settings, overlap=2 * settings.overlap, degree=2 * settings.degree, beam=4 * settings.beam)
    for search in (lambda some: link_counts(some, threshold, wider), lambda some: exact_counts(some, threshold, settings)):
        low = low_labels(true, counts, least_recall)
        if not low:
            break
        again = nodes.filter(F.col("label").isin(low))
        more, ties = search(again)
        counts = counts.join(again.select("node").hint("merge"), "node", "left_anti").union(more)
        links = links.union(ties)
    recall = audit(true, counts, whole)
    tied_nodes = components(links).withColumnRenamed("component", "root")
    by_node = (
        nodes.select("node", "copies")
        .join(counts.hint("merge"), "node", "left")
        .join(tied_nodes.hint("merge"), "node", "left")
        .select("node", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    same = F.struct(F.col(label_column).cast("string"), F.transform(vector_column, lambda v: v.cast("double") + F.lit(0.0)))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), same.alias("same"))
    standing = rows.groupBy("same").agg(F.min("id").alias("node"))
    named = rows.hint("merge").join(standing, "same").select("id", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    return named.hint("merge").join(by_node, "node", "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("root", "id").alias("component_id"),
        F.coalesce("root", "id").eqNullSafe(F.col("id")).alias("kept"),
        F.lit(recall).cast("double").alias("audited_recall"),
    )


def audit_sample(nodes: DataFrame, found: DataFrame, threshold: float, settings: Settings = Settings()) -> tuple[DataFrame, bool]:
    """``(label, node, true)``, the links of some nodes by brute force, and whether these are all nodes.

    The sample is bounded (smallest hashed ids, and as many again of the nodes with ``found`` links) and
    compared with all rows, in one pass. It is enlarged while it has met too few links.
    """
    spark, size = nodes.sparkSession, settings.audit_rows
    by_hash = [F.xxhash64("node", F.lit(settings.seed + 3)), "node"]
    linked = nodes.join(found.select("node").hint("merge"), "node", "left_semi")
    while True:
        samples = [frame.orderBy(*by_hash).limit(size).select("label", "node", "vector").collect() for frame in (nodes, linked)]
        whole = len(samples[0]) < size
        by_label: dict[str, dict[int, np.ndarray]] = {}
        for r in samples[0] + samples[1]:
            by_label.setdefault(r["label"], {})[r["node"]] = np.frombuffer(r["vector"], np.float64)
        asked = {label: (np.array(list(own)), np.stack(list(own.values()))) for label, own in by_label.items()}

        def compared(frames: Iterator[pd.DataFrame], asked: dict = asked) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for label, part in frame.groupby("label", sort=False):
                    if label in asked:
                        ids, own = asked[label]
                        near = own @ stacked(part["vector"]).T >= threshold
                        near &= ids[:, None] != part["node"].to_numpy()[None, :]
                        yield pd.DataFrame({"label": label, "node": ids, "true": (near * part["copies"].to_numpy()).sum(axis=1)})

        true = nodes.mapInPandas(compared, "label string, node bigint, true bigint").groupBy("label", "node").agg(F.sum("true").alias("true"))
        true = materialise(true, "audit")
        seen = true.agg(F.sum("true")).first()[0] or 0
        if whole or seen >= settings.audit_links or size >= settings.audit_most:
            return true, whole
        size *= 4


def shares(true: DataFrame, found: DataFrame) -> DataFrame:
    both = true.join(found.hint("merge"), "node", "left")
    return both.select("label", "true", F.least(F.coalesce("found", F.lit(0)), "true").alias("got"))


def low_labels(true: DataFrame, found: DataFrame, least_recall: float) -> list[str]:
    """Labels of the sample with a lower share of links found."""
    sums = shares(true, found).groupBy("label").agg(F.sum("true").alias("true"), F.sum("got").alias("got"))
    return [r["label"] for r in sums.filter(F.col("got") < least_recall * F.col("true")).collect()]


def audit(true: DataFrame, found: DataFrame, whole: bool) -> float | None:
    """Share of the links of the sampled nodes that were found; ``found`` is ``(node, found)``.

    Without a link there is nothing to measure: null, or 1 if the sample is the whole table.
    """
    sums = shares(true, found).agg(F.sum("true"), F.sum("got")).first()
    return float(sums[1] / sums[0]) if sums[0] else 1.0 if whole else None
