"""Embedding near-duplicates by an inverted multi-index.

Each half of a unit vector has a codebook of its own; the two nearest codes are a cell of the
product grid, and every vector is listed in its cell.  A vector is compared with the cells that
come next in multi-sequence order: pairs of codes by growing lower bound of the distance to their
cell (the distance to the planes between codes, squared and summed over the halves).  How far the
order must be followed is measured: a fixed number of vectors, chosen by hash, is compared with
all others, and the traversal stops at the bound that reaches the target recall on the true
partners of each of them, in the mean.  At the radius that the cosine threshold leaves, no partner
could lie beyond: a recall of 1 asks for all of it, and is exact.  Each pair is met once, from the
cell with the smaller number, in blocks of bounded size, and verified in double precision.  The
grid grows with the rows, so that a cell's do not.  Vectors of each length have a grid of their
own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import hashed_sample, materialize, table
from feedloom.llm.components import connected_components

COSINE = 0.98
#: Codes of a half at least and at most (in between, cells for every ``PER_CELL`` rows), rows that
#: the codebooks are fitted on (chosen by hash), rounds of the fit.
CODES, MOST_CODES, PER_CELL, FIT_ROWS, ROUNDS = 64, 1024, 16, 20_000, 12
#: Planes that bound a cell: those of the codes nearest to the vector.
PLANES = 64
#: Vectors of a block; two blocks are compared at once.
BLOCK = 512
#: Vectors compared with all others to set the traversal's end, the recall that it is set for, and
#: the share of the whole radius that is always visited.
QUERIES, TARGET, LEAST = 512, 0.999, 0.05


def codebook(points: np.ndarray, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means centres, begun with far points."""
    rng = np.random.default_rng(7)
    if not len(points):
        return np.zeros((1, points.shape[1]))
    centres = points[rng.integers(len(points))][None]
    far = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < codes and far.max() > 1e-9:
        pick = points[rng.choice(len(points), p=far / far.sum())]
        centres = np.vstack([centres, pick])
        far = np.minimum(far, ((points - pick) ** 2).sum(axis=1))
    for _ in range(rounds):
        near = distances(points, centres).argmin(axis=1)
        for k in range(len(centres)):
            if (own := near == k).any():
                centres[k] = points[own].mean(axis=0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def cell_bounds(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared lower bounds of the distances from each row to the codes' regions: a region lies
    behind the planes half way between its centre and every other one.  With many codes only
    the planes of those nearest to the row are looked at; fewer planes bound less, never more."""
    d = distances(x, centres)
    gap = np.sqrt(distances(centres, centres))
    gap = np.where(gap > 1e-12, gap, np.inf)
    out = np.zeros_like(d)
    if len(centres) <= PLANES:
        for k in range(len(centres)):
            out = np.maximum(out, (d - d[:, k : k + 1]) / (2 * gap[k]))
    else:
        near = np.argpartition(d, PLANES // 8, axis=1)[:, : PLANES // 8]
        for k in near.T:
            out = np.maximum(out, (d - np.take_along_axis(d, k[:, None], axis=1)) / (2 * gap[k]))
    return out**2


def multi_sequence(first: np.ndarray, second: np.ndarray, radius: float) -> np.ndarray:
    """Cells (i, j) in order of first[i] + second[j], up to the radius, as i * len(second) + j."""
    import heapq

    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap and heap[0][0] <= radius:
        _, i, j = heapq.heappop(heap)
        out.append(a[i] * len(second) + b[j])
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(a) and v < len(b) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (first[a[u]] + second[b[v]], u, v))
    return np.array(out, np.int64)


def unit(rows: pa.Array, width: int) -> np.ndarray:
    """Rows as unit vectors in double precision.  They are scaled by a power of two first, which
    changes no digit, so that no square is too large or too small."""
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    most = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = np.ldexp(x, -np.frexp(most)[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows in parts of one vector length."""
    widths = pc.list_value_length(batch.column("v")).to_numpy()
    found = np.unique(widths)
    for width in found:
        yield int(width), batch if len(found) == 1 else batch.filter(pa.array(widths == width))


class Grid:
    """Codebooks of the two halves, by vector length.  A length that no fitted row has is rare; its
    vectors of a label are one cell."""

    def __init__(self, sample: list[pa.Array], codes: int):
        self.books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for rows in sample:
            width = len(rows[0])
            points, half = unit(rows, width), width // 2
            own = max(1, min(codes, len(points) // 2))
            self.books[width] = codebook(points[:, :half], own), codebook(points[:, half:], own)

    def of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        half = width // 2
        return self.books.get(width) or (np.zeros((1, half)), np.zeros((1, width - half)))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of each row's own cell."""
        (one, two), half = self.of(x.shape[1]), x.shape[1] // 2
        return distances(x[:, :half], one).argmin(axis=1), distances(x[:, half:], two).argmin(axis=1)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (one, two), half = self.of(x.shape[1]), x.shape[1] // 2
        return cell_bounds(x[:, :half], one), cell_bounds(x[:, half:], two)


#: Bounds are counted in this many parts of the radius.
STEPS = 100


def _needed(grid: Grid, cosine: float, queries: list[tuple[int, str, np.ndarray]]):
    """(query, step, n): counts of the queries' true partners, without the query's own row, by the
    bound of the partner's cell."""
    radius, groups = 2 - 2 * cosine, {}
    for width in {len(v) for _, _, v in queries}:
        own = [q for q in queries if len(q[2]) == width]
        x = np.array([v for _, _, v in own])
        groups[width] = np.array([q for q, _, _ in own]), np.array([t for _, t, _ in own]), x, grid.bounds(x)
    names = np.array([q for q, _, _ in queries])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(queries), STEPS + 2), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                for width, part in by_width(b.slice(at, 2048)):
                    if width not in groups:
                        continue
                    vec, labels, y, (one, two) = groups[width]
                    x, label = unit(part.column("v"), width), np.array(part.column("label").to_pylist())
                    row = part.column("vec").to_numpy()
                    i, j = np.nonzero((x @ y.T >= cosine) & (label[:, None] == labels[None, :]) & (row[:, None] != vec[None, :]))
                    a, c = grid.home(x)
                    step = np.minimum(np.ceil((one[j, a[i]] + two[j, c[i]]) / radius * STEPS), STEPS + 1).astype(int)
                    np.add.at(total, (np.searchsorted(names, vec[j]), step), 1)
        q, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(step), pa.array(total[q, step])], ["query", "step", "n"])

    return count


def _stop(distinct: DataFrame, grid: Grid, cosine: float, recall: float) -> float:
    """The squared bound at which the traversal ends."""
    radius = 2 - 2 * cosine
    if recall >= 1:
        return radius
    chosen = hashed_sample(distinct, QUERIES, "vec", "label").select("vec", "label", "v").toArrow()
    if not len(chosen):
        return 0.0
    queries = []
    for b in chosen.to_batches():
        for width, part in by_width(b):
            queries += zip(part.column("vec").to_pylist(), part.column("label").to_pylist(), unit(part.column("v"), width))
    queries.sort(key=lambda q: q[:2])
    found = distinct.select("vec", "label", "v").mapInArrow(_needed(grid, cosine, queries), "query long, step long, n long")
    by_query: dict[int, np.ndarray] = {}
    for q, step, n in found.groupBy("query", "step").agg(F.sum("n")).collect():  # at most QUERIES x STEPS rows
        by_query.setdefault(q, np.zeros(STEPS + 2))[step] = n
    if not by_query:
        return radius * LEAST
    reached = np.mean([np.cumsum(c) / c.sum() for c in by_query.values()], axis=0)
    return radius * min(1.0, max(LEAST, int(np.argmax(reached >= recall)) / STEPS))


PLACED = ["vec", "label", "width", "size", "v", "cells"]


def _assigner(grid: Grid, radius: float):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for width, part in by_width(b):
                x, top = unit(part.column("v"), width), len(grid.of(width)[1])
                (one, two), (a, c) = grid.bounds(x), grid.home(x)
                own, cells = a * top + c, []
                for k in range(len(x)):
                    met = multi_sequence(one[k], two[k], radius)
                    cells.append(np.concatenate([own[k : k + 1], met[met > own[k]]]))
                edge = np.concatenate([[0], np.cumsum([len(c) for c in cells])])
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(np.concatenate(cells)))
                widths = pa.array(np.full(len(x), width, np.int32))
                yield pa.RecordBatch.from_arrays([part.column("vec"), part.column("label"), widths, part.column("size"), part.column("v"), lists], PLACED)

    return assign


LINKS = "a long, b long, n long"


def _comparer(cosine: float):
    """Rows are pairs of blocks: members of a cell with visitors of the cell, or with themselves.

    Emits, for each vector with links, how many there are (a, null, n), and links (a, b, null)
    that span the classes that the blocks' links make."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for row in range(batch.num_rows):
                ids, other = (batch.column(c)[row].values.to_numpy() for c in ("ids", "other_ids"))
                sizes, more = (batch.column(c)[row].values.to_numpy() for c in ("sizes", "other_sizes"))
                width = batch.column("width")[row].as_py()
                x, y = (unit(batch.column(c)[row].values, width) for c in ("vs", "other_vs"))
                own = batch.column("own")[row].as_py()
                near = np.einsum("ik,jk->ij", x, y) >= cosine
                if own:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                count_x, count_y = np.zeros(len(ids), np.int64), np.zeros(len(other), np.int64)
                np.add.at(count_x, i, more[j])
                np.add.at(count_y, j, sizes[i])
                out += [(int(a), None, int(n)) for a, n in zip(ids, count_x) if n]
                out += [(int(a), None, int(n)) for a, n in zip(other, count_y) if n]
                out += _spanning(ids[i].tolist(), other[j].tolist())
                if len(out) > 50_000:
                    yield _links(out)
                    out = []
        if out:
            yield _links(out)

    return compare


def _links(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b", "n"])


def _spanning(a: list[int], b: list[int]) -> list[tuple]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for x, y in zip(a, b):
        u, v = find(x), find(y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((x, y, None))
    return out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, codes: int | None = None, block: int = BLOCK, recall: float = TARGET) -> DataFrame:
    """``vectors(vec_id, label, embedding, ...)`` -> a row per row: vec_id, n_links,
    component_id, kept.

    Vectors of one label and length whose cosine is at least ``cosine`` are linked; ``recall`` is
    the share of links that the traversal is set to find, 1 finds all.  Rows without a label or
    id, and vectors that are null, empty, zero, or hold null or non-finite components, link with
    nothing.  Equal vectors of a label are compared once and counted as often as they occur;
    repeated rows of an id count as further vectors.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding").cast(f"array<{kind if kind in ('float', 'double') else 'double'}>")  # floats stay half as wide
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = ~odd & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    distinct = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").cast("long").alias("vec"), F.count("*").alias("size"))
    distinct = materialize(distinct, "vectors")
    if codes is None:
        codes = min(MOST_CODES, max(CODES, int((distinct.count() / PER_CELL) ** 0.5)))
    sample = hashed_sample(distinct, FIT_ROWS, "vec").select("v").toArrow()
    fitted: dict[int, list[pa.Array]] = {}
    for batch in sample.to_batches():
        for width, part in by_width(batch):
            fitted.setdefault(width, []).append(part.column("v"))
    grid = Grid([pa.concat_arrays(x) for x in fitted.values()], codes)
    assign = _assigner(grid, _stop(distinct, grid, cosine, recall))
    kind = distinct.schema["v"].dataType.simpleString()
    placed = distinct.select("vec", "label", "size", "v").mapInArrow(assign, f"vec long, label string, width int, size long, v {kind}, cells array<long>")
    placed = materialize(placed, "cells")
    cell = ["label", "width", "cell"]
    members = placed.select("label", "width", F.element_at("cells", 1).alias("cell"), "vec", "v", "size")
    visits = placed.select("label", "width", F.explode(F.slice("cells", 2, 1 << 30)).alias("cell"), "vec", "v", "size")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # only cells that have members are worth a visit
    filled = members.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    filled = materialize(filled, "filled-cells")

    def blocks(df: DataFrame, prefix: str) -> DataFrame:
        counts = df.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
        counts = materialize(counts, "cell-counts")  # the join then reads plain shuffles, which split at a large cell
        dealt = df.join(counts, cell).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")))
        # dealt anew, so that a cell of many parts is not grouped where the join left it
        dealt = dealt.repartition(parts, *cell, "part")
        return dealt.groupBy(*cell, "part").agg(
            F.collect_list("vec").alias(f"{prefix}ids"), F.collect_list("v").alias(f"{prefix}vs"), F.collect_list("size").alias(f"{prefix}sizes")
        )

    mine = materialize(blocks(members, ""), "member-blocks")
    useful = visits.join(filled.select(*cell), cell, "left_semi")
    theirs = blocks(useful, "other_").withColumn("own", F.lit(False)).drop("part")
    same = mine.select(*cell, F.col("part").alias("other_part"), F.col("ids").alias("other_ids"), F.col("vs").alias("other_vs"), F.col("sizes").alias("other_sizes"))
    inside = mine.join(same, cell).where("part <= other_part").withColumn("own", F.col("part") == F.col("other_part"))
    names = ["own", "width", "ids", "vs", "sizes", "other_ids", "other_vs", "other_sizes"]
    across = mine.join(theirs, cell)
    pairs = inside.select(*names).unionByName(across.select(*names)).repartition(parts)
    links = materialize(pairs.mapInArrow(_comparer(cosine), LINKS), "vector-links")
    count = links.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    classes = connected_components(links.where("b is not null").select("a", "b"))
    of = distinct.join(count, distinct.vec == count.a, "left").join(classes, distinct.vec == classes.id, "left")
    of = of.select("label", "v", (F.coalesce("n", F.lit(0).cast("long")) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component_id"))
    out = rows.join(of.withColumn("ok", F.lit(True)), ["ok", "label", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
with recursive e as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
), ok as (
  select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from e
  where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
), l as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id
  where a.norm > 0 and b.norm > 0 and list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), r(id, c) as (
  select vec_id, vec_id from e
  union
  select l.b, r.c from r join l on l.a = r.id where r.c < l.b
), n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(max(n.n), 0) as n_links, min(r.c) as component_id, e.vec_id = min(r.c) as kept
from e join r on r.id = e.vec_id left join n on n.a = e.vec_id group by e.vec_id
"""
