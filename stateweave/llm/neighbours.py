"""Approximate nearest neighbours by cosine: balanced posting lists around centroids.

Centroids come from splitting a bounded sample (``SAMPLE`` vectors and ``SAMPLE_BYTES``) again and again by k-means until no part
holds more than its share, so that lists are balanced. Each of the ``SIZES`` commonest vector sizes has its own; a rarer one is
one list. A list of over ``SPLIT`` vectors is cut up by inner centroids from a bounded sample of its own, so lists stay short as
their number grows. Every vector is posted to its nearest centroid and, if it lies near a boundary, to up to ``COPIES``
centroids whose distance is within ``1 + SPREAD`` of the nearest. Centroids are searched by best-first steps over a graph of
near centroids, kept in memory (at most ``MAX_LISTS`` of one size or list). A query reads the ``LEAST_LISTS`` nearest lists and
all lists whose centroid lies within ``1 + PRUNE`` of its nearest one's distance, and likewise inside large ones; every vector
that a matrix product puts within ``SLACK`` of a block's best is scored pair by pair in double precision, so ties are ties. A
query that has found fewer than ``k`` others so is compared with all vectors of its size, in blocks.

Lists are stored in blocks of about ``BLOCK`` vectors, and queries that share a vector are searched once. Of equal vectors
the ``k + 1`` least ids are posted: no other can be among the ``k`` nearest, as ties go to smaller ids.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; vectors are compared with
those of their own size; a query with fewer candidates gets all; repeated rows with one id count once; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize, small, spread_join

EVERY = 50
NEAREST = 5
SAMPLE = 50_000
LIST = 256
MAX_LISTS = 16_384
#: Vectors of a size from which it has centroids of its own, and how many sizes have; a larger list has inner ones.
RARE = 1024
SIZES = 64
SPLIT = 8192
INNER_SAMPLE = 16_384
SAMPLE_BYTES = 100_000_000
COPIES = 4
SPREAD = 0.12
PRUNE = 0.22
LEAST_LISTS = 4
BLOCK = 1024
DEGREE = 16
#: More than a matrix product of unit vectors can be off.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Cluster of each row, spherical."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        mine = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, mine, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return (x @ c.T).argmax(1)


def centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """About ``lists`` unit centroids, each of about the same number of the unit rows ``x``."""
    if not len(x):
        return np.ones((1, 1), np.float32)
    rng = np.random.default_rng(3)
    most = max(1, -(-len(x) // max(1, lists)))
    todo, out = [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        if len(part) > most:
            mine = kmeans(x[part], min(8, -(-len(part) // most) + 1, len(part)), rng)
            pieces = [part[mine == j] for j in np.unique(mine)]
            if len(pieces) > 1:
                todo += pieces
                continue
        mean = x[part].mean(0)
        out.append(mean / max(np.linalg.norm(mean), 1e-9))
    return np.array(out, np.float32).reshape(len(out), x.shape[1] if x.ndim == 2 else 0)


class Graph:
    """Near centroids as neighbours of each other, searched best first for many rows at once."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE):
        self.points = points
        n = len(points)
        self.near = np.zeros((n, min(degree, n)), np.int64)
        for at in range(0, n, 1024):
            sims = points[at : at + 1024] @ points.T
            self.near[at : at + 1024] = np.argpartition(-sims, self.near.shape[1] - 1, 1)[:, : self.near.shape[1]]
        rng = np.random.default_rng(4)  # some far links, so that no part of the graph is cut off
        self.near = np.hstack([self.near, rng.integers(0, n, (n, min(4, n)))])
        self.start = np.unique(rng.integers(0, n, 64))

    def search(self, x: np.ndarray, want: int = 0, spread: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances (euclidean, on the unit sphere), nearest first, of the nearest points found.

        At most ``want`` of them; if that is 0, at least all found within ``1 + spread`` of the nearest one's distance.
        """
        n = len(x)
        width = min(len(self.points), max(2 * want, 32))
        seen = np.zeros((n, len(self.points)), bool)
        ids = np.broadcast_to(self.start, (n, len(self.start)))
        sims = x @ self.points[self.start].T
        seen[:, self.start] = True
        done = np.zeros(ids.shape, bool)
        while True:
            keep = width
            if not want:
                radius = (1 + spread) ** 2 * (2 - 2 * sims.max(1, keepdims=True))
                keep = max(width, int((2 - 2 * sims <= radius).sum(1).max()))
            order = np.argsort(-sims, 1, kind="stable")[:, :keep]
            ids, sims, done = (np.take_along_axis(v, order, 1) for v in (ids, sims, done))
            open_ = ~done & np.isfinite(sims)
            if not open_.any():
                break
            step = np.cumsum(open_, 1) <= 4  # the four best that aren't expanded yet
            row, col = np.nonzero(open_ & step)
            done[row, col] = True
            new = self.near[ids[row, col]]
            rows = np.repeat(row, new.shape[1])
            new = new.ravel()
            flat = np.unique(rows * len(self.points) + new)
            rows, new = flat // len(self.points), flat % len(self.points)
            fresh = ~seen[rows, new]
            rows, new = rows[fresh], new[fresh]
            seen[rows, new] = True
            if not len(rows):
                continue
            slot = np.arange(len(rows)) - np.searchsorted(rows, rows)
            more = np.full((n, int(slot.max()) + 1), -np.inf, sims.dtype)
            more_ids = np.zeros(more.shape, np.int64)
            more[rows, slot] = np.einsum("ij,ij->i", x[rows], self.points[new])
            more_ids[rows, slot] = new
            ids, sims, done = np.hstack([ids, more_ids]), np.hstack([sims, more]), np.hstack([done, np.zeros(more.shape, bool)])
        if want:
            ids, sims = ids[:, :want], sims[:, :want]
        return ids, np.sqrt(np.maximum(0, 2 - 2 * sims))


def _vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v, h1, h2): valid vectors as doubles and two hashes of them; one row per id."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, out = [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values, np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append((x + 0.0).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])

        return work

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    found = map_rows(rows, make, "vec_id long, v binary").dropDuplicates(["vec_id"])
    return materialize(found.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")}), "vectors")


def _posted(vectors: DataFrame, index: dict[int, np.ndarray], spread: float, copies: int = 0, least: int = 1) -> DataFrame:
    """Each row with the lists of its size that it belongs to, as array ``lists``; sizes without centroids have the one list 0."""

    def make():
        graphs = {size: Graph(points) for size, points in index.items()}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = batch.column("v").to_pylist()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            lists: list[np.ndarray] = [np.zeros(1, np.int64)] * len(raw)
            for size in np.intersect1d(sizes, list(graphs)).tolist():
                rows = np.flatnonzero(sizes == size)
                for k, some in zip(rows.tolist(), lists_of(graphs[size], [raw[k] for k in rows], spread, copies, least), strict=True):
                    lists[k] = some
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))
            return pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "lists"])

        return work

    schema = ", ".join(f"{c} {t}" for c, t in vectors.dtypes)
    return map_rows(vectors, make, f"{schema}, lists array<long>", 1024)


def lists_of(graph: Graph, raw: list[bytes], spread: float, copies: int, least: int) -> list[np.ndarray]:
    """The lists of each vector: the nearest, the ``least`` nearest, and those within ``1 + spread`` of its distance (``copies`` at most, if not 0)."""
    x = unit(np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)).astype(np.float32)
    ids, far = graph.search(x, copies, spread)
    near = np.isfinite(far) & (far <= (1 + spread) * np.maximum(far[:, :1], 1e-6))
    near[:, :least] |= np.isfinite(far[:, :least])
    return [i[n] for i, n in zip(ids, near, strict=True)]


CELL = ["size", "list"]


def _flat(posted: DataFrame, key: list[str]) -> DataFrame:
    return posted.select(F.length("v").alias("size"), F.explode("lists").alias("list"), *key, "v")


def _inner(flat: DataFrame, large: DataFrame) -> DataFrame:
    """(size, list, points): centroids within lists of over ``SPLIT`` vectors, each from a bounded sample of its list, in one task each."""
    share = F.least(F.lit(INNER_SAMPLE), F.lit(SAMPLE_BYTES / 4) / F.col("size")) / F.col("n")
    uniform = F.xxhash64("vec_id", F.lit(43)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    sample = flat.join(small(large), CELL).where(uniform < share).groupBy(*CELL, "n").agg(F.collect_list("v").alias("some"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            points = []
            for size, n, some in zip(batch.column("size").to_pylist(), batch.column("n").to_pylist(), batch.column("some").to_pylist(), strict=True):
                x = unit(np.frombuffer(b"".join(some), np.float64).reshape(-1, size // 8)).astype(np.float32)
                points.append(centroids(x, min(max(1, len(x) // 2), -(-n // LIST))).tobytes())
            return pa.RecordBatch.from_arrays([batch.column("size"), batch.column("list"), pa.array(points, pa.binary())], [*CELL, "points"])

        return work

    return materialize(map_rows(sample, make, "size int, list long, points binary", 1), "inner")


def _dealt(flat: DataFrame, key: list[str], inner: DataFrame | None, spread: float, copies: int = 0, least: int = 1) -> DataFrame:
    """``flat`` with ``sub``, the inner list of rows in large lists (0 in others); pieces of a list meet its centroids in tasks of their own."""
    if inner is None:
        return flat.withColumn("sub", F.lit(0).cast("long"))
    parts = flat.join(small(materialize(inner.select(*CELL), "large")), CELL).groupBy(*CELL).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    parts = small(materialize(parts, "parts"))
    left = flat.join(parts, CELL).withColumn("part", F.pmod(F.xxhash64(*key), "parts").cast("int")).drop("parts")
    right = inner.join(parts, CELL).select(*CELL, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "points")
    names, types = [*CELL, *key, "v"], dict(flat.dtypes)

    def choose(rows: pa.Table, points: pa.Table) -> pa.Table:
        raw = rows.column("v").to_pylist()
        if not raw or not points.num_rows:
            return rows.select(names).append_column("sub", pa.nulls(rows.num_rows, pa.int64())).slice(0, 0)
        graph = Graph(np.frombuffer(points.column("points")[0].as_py(), np.float32).reshape(-1, len(raw[0]) // 8))
        lists = lists_of(graph, raw, spread, copies, least)
        again = np.repeat(np.arange(len(raw)), [len(x) for x in lists])
        return rows.select(names).take(pa.array(again)).append_column("sub", pa.array(np.concatenate(lists)))

    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", sub long"
    inside = left.groupBy(*CELL, "part").cogroup(right.groupBy(*CELL, "part")).applyInArrow(choose, schema)
    others = flat.join(parts, CELL, "left_anti").withColumn("sub", F.lit(0).cast("long"))
    return inside.unionByName(others)


LISTS = [*CELL, "sub"]


def _blocks(dealt: DataFrame, key: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Lists in blocks of about ``BLOCK`` rows, and how many blocks each has."""
    sizes = materialize(dealt.groupBy(*LISTS).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "list-blocks")
    chosen = dealt.join(small(sizes), LISTS).withColumn("block", F.pmod(F.xxhash64(*key), "blocks").cast("int"))
    return chosen.groupBy(*LISTS, "block").agg(F.collect_list(F.struct(*key, "v")).alias(name)), sizes


def _met(posts: DataFrame, posted: DataFrame, asks: DataFrame, asked: DataFrame) -> DataFrame:
    """Every block of queries of a list with every block of its vectors; a list that many queries read is copied to several tasks."""
    spread = asks.withColumnRenamed("block", "ask").join(small(posted), LISTS).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    place = F.struct(*LISTS, "block").alias("place")
    counts = asked.withColumnRenamed("blocks", "n").join(small(posted), LISTS).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(place, "n")
    return spread_join(spread.select(place, "ask", "asks"), posts.select(place, "posts"), "place", counts, F.col("ask"), 4).select("posts", "asks")


def _scored(nearest: int):
    """For rows of blocks (``posts``, ``asks``): for each ask its ``nearest + 1`` best posts, by exact scores and then ids."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = []
        for p, a in zip(batch.column("posts"), batch.column("asks"), strict=True):
            ids = np.asarray(p.values.field(0))
            v = np.frombuffer(b"".join(p.values.field(1).to_pylist()), np.float64).reshape(len(ids), -1)
            h1, h2 = np.asarray(a.values.field(0)), np.asarray(a.values.field(1))
            q = np.frombuffer(b"".join(a.values.field(2).to_pylist()), np.float64).reshape(len(h1), -1)
            sims = unit(q) @ unit(v).T
            least = np.partition(sims, max(0, len(ids) - nearest - 1), 1)[:, max(0, len(ids) - nearest - 1)]
            row, col = np.nonzero(sims >= least[:, None] - SLACK)
            score = np.add.reduce(q[row] * v[col], 1) / np.sqrt(np.add.reduce(q[row] * q[row], 1) * np.add.reduce(v[col] * v[col], 1))
            order = np.lexsort((ids[col], -score, row))
            first = np.searchsorted(row[order], np.arange(len(q)))
            keep = order[np.arange(len(order)) - first[row[order]] < nearest + 1]
            out.append([h1[row[keep]], h2[row[keep]], ids[col[keep]], score[keep]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["h1", "h2", "vec_id", "score"])

    return work


def _everything(kept: DataFrame, short: DataFrame) -> DataFrame:
    """All vectors of the sizes of ``short`` in blocks, each with every block of ``short`` of its size."""
    sizes = short.groupBy(F.length("v").alias("size")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asking"))
    counts = small(materialize(kept.groupBy(F.length("v").alias("size")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(sizes, "size"), "own-sizes"))
    posts = kept.withColumn("size", F.length("v")).join(counts, "size").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    posts = posts.groupBy("size", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("posts"))
    asks = short.withColumn("size", F.length("v")).join(counts, "size").withColumn("ask", F.pmod(F.xxhash64("h1", "h2"), "asking").cast("int"))
    asks = asks.groupBy("size", "ask", "blocks").agg(F.collect_list(F.struct("h1", "h2", "v")).alias("asks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return posts.join(asks, ["size", "block"]).select("posts", "asks")


def _index(kept: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """Centroids for each of the ``SIZES`` commonest sizes (bytes of a vector) of over ``SPLIT`` vectors, from at most about ``sample`` vectors and ``SAMPLE_BYTES``."""
    sizes = kept.groupBy(F.length("v").alias("size")).agg(F.count("*").alias("n")).where(F.col("n") > RARE).orderBy(F.desc("n"), F.desc("size")).limit(SIZES).collect()
    total, width = sum(r.n for r in sizes), sum(r.n * r["size"] for r in sizes)
    if not total:
        return {}
    share = min(1.0, sample / total, SAMPLE_BYTES / width)
    uniform = F.xxhash64("vec_id", F.lit(41)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    got = kept.where(F.length("v").isin([r["size"] for r in sizes]) & (uniform < share)).select("v").toArrow().column("v").to_pylist()
    out = {}
    for r in sizes:
        raw = [v for v in got if len(v) == r["size"]]
        if raw:
            x = unit(np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)).astype(np.float32)
            out[r["size"]] = centroids(x, max(1, min(MAX_LISTS, r.n // LIST, len(raw) // 2)))
    return out


def search(rows: DataFrame, every: int = EVERY, nearest: int = NEAREST, sample: int = SAMPLE, prune: float = PRUNE) -> DataFrame:
    """The ``nearest`` vectors found for each row whose id is divisible by ``every``: query_id, rank, vec_id and score."""
    vectors = _vectors(rows)
    by_vector = Window.partitionBy("h1", "h2").orderBy("vec_id")
    kept = materialize(vectors.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= nearest + 1).drop("r"), "kept")
    queries = materialize(vectors.where(F.col("vec_id") % every == 0), "queries")
    asked = materialize(queries.dropDuplicates(["h1", "h2"]).select("h1", "h2", "v"), "asked")
    index = _index(kept, sample)
    posted = _flat(materialize(_posted(kept.select("vec_id", "v"), index, SPREAD, COPIES), "posted"), ["vec_id"])
    wanted = _flat(materialize(_posted(asked, index, prune, least=LEAST_LISTS), "wanted"), ["h1", "h2"])
    large = materialize(posted.groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") > SPLIT), "large-lists")
    inner = None if large.isEmpty() else _inner(posted, large)
    posts, post_blocks = _blocks(_dealt(posted, ["vec_id"], inner, SPREAD, COPIES), ["vec_id"], "posts")
    asks, ask_blocks = _blocks(_dealt(wanted, ["h1", "h2"], inner, prune, least=LEAST_LISTS), ["h1", "h2"], "asks")
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")

    def nearest_of(blocks: DataFrame) -> DataFrame:
        found = map_rows(blocks, lambda: _scored(nearest), "h1 long, h2 long, vec_id long, score double", 8).dropDuplicates(["h1", "h2", "vec_id"])
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= nearest + 1).drop("r")

    found = materialize(nearest_of(_met(posts, post_blocks, asks, ask_blocks)), "found")
    full = found.groupBy("h1", "h2").count().where(F.col("count") > nearest).select("h1", "h2")
    short = materialize(asked.join(full, ["h1", "h2"], "left_anti"), "short")
    if not short.isEmpty():
        found = found.join(short, ["h1", "h2"], "left_anti").unionByName(nearest_of(_everything(kept, short)))
    lists = materialize(found.groupBy("h1", "h2").agg(F.collect_list(F.struct("vec_id", "score")).alias("near")), "found")
    answers = queries.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(lists, ["h1", "h2"])
    others = F.filter("near", lambda n: n["vec_id"] != F.col("query_id"))
    ordered = F.slice(F.array_sort(F.transform(others, lambda n: F.struct((-n["score"]).alias("s"), n["vec_id"].alias("i")))), 1, nearest)
    ranked = answers.select("query_id", F.posexplode(ordered).alias("p", "n"))
    return ranked.select("query_id", (F.col("p") + 1).alias("rank"), F.col("n.i").alias("vec_id"), (-F.col("n.s")).alias("score"))
