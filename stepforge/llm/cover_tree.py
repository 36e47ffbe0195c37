"""Embedding near-duplicates by dual traversal of a cover tree (operator 2).

The tree's levels are nested nets with halving radii. Its upper nodes come
from a bounded sample, every vector goes to its nearest one, and the nodes'
covering radii are measured over all vectors. Lower levels are built once per
cell of bounded size and travel with the vectors. Going down both sides at once,
a pair of nodes is dropped if the angle of their centres exceeds the sum of
their covering radii and the threshold's angle, and taken whole if angle and
radii stay below it; what is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import Scratch, connected_components

#: Radii of the levels inside a cell, finest first; the next is always twice as large.
LEVELS = (0.25, 0.5, 1.0)
#: Numbers that the vectors of a cell hold together.
CELL_NUMBERS = 1 << 20
#: A level that keeps more than this share of the nodes below it is left out (an explicit tree).
WORTHWHILE = 0.6


def net(x: np.ndarray, radius: float) -> np.ndarray:
    """For each unit vector the place of its centre: the first one within ``radius``, or itself."""
    least, n = 1 - radius * radius / 2, len(x)
    of, centres = np.full(n, -1), []
    for at in range(0, n, 256):
        block = x[at : at + 256]
        open_ = np.arange(len(block))
        if centres:
            s = block @ x[centres].T
            best = s.argmax(axis=1)
            near = s[open_, best] >= least
            of[at + open_[near]] = np.array(centres)[best[near]]
            open_ = open_[~near]
        s = block[open_] @ block[open_].T >= least
        for i, own in enumerate(open_):
            if of[at + own] < 0:
                take = open_[i:][s[i, i:] & (of[at + open_[i:]] < 0)]
                of[at + take] = of[at + own] = at + own
                centres.append(at + own)
    return of


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Places of at most ``most`` centres; every prefix is a net, with radii that fall."""
    chosen, far = [0], 2 - 2 * (x @ x[0])
    while len(chosen) < min(most, len(x)) and far.max() > LEVELS[0] ** 2:
        chosen.append(int(far.argmax()))
        np.minimum(far, 2 - 2 * (x @ x[chosen[-1]]), out=far)
    return np.array(chosen)


def angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def parents(x: np.ndarray) -> list[np.ndarray]:
    """For each level, finest first, the place of every vector's centre there; a level that merges little repeats the one below."""
    out, own = [], np.arange(len(x))
    light = x.astype(np.float32)
    for radius in LEVELS:
        below = np.unique(own)
        of = below[net(light[below], radius)]
        centres = np.unique(of)
        if len(centres) < len(below) and (len(centres) <= WORTHWHILE * len(below) or not out):
            up = np.arange(len(x))
            up[below] = of
            own = up[own]
        out.append(own)
    return out


class Cell:
    """Levels of nodes over some unit vectors: centres, covering radii (angles), children, each vector's node, weights."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, of: list[np.ndarray]):
        self.x, self.weight = x, weight
        self.members: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.levels: list[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]] = []
        below = every = np.arange(len(x))
        for own in of:
            centres, node = np.unique(own, return_inverse=True)
            if len(centres) == len(below):
                continue
            up = node[below]
            order = np.argsort(up, kind="stable")
            children = np.split(order, np.searchsorted(up[order], np.arange(1, len(centres))))
            away = angle(np.einsum("ij,ij->i", x, x[own]))
            away[every == own] = 0
            radii = np.zeros(len(centres))
            np.maximum.at(radii, node, away)
            self.levels.append((centres, radii + 1e-7, children, node, np.bincount(node, weight, len(centres)).astype(np.int64)))
            below = centres

    def at(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Centres and radii of a level; below the last one, the vectors themselves."""
        return self.levels[level][:2] if level >= 0 else (np.arange(len(self.x)), np.zeros(len(self.x)))

    def within(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's vectors, as (place in ``nodes``, vector)."""
        if level < 0:
            return np.arange(len(nodes)), nodes
        if level not in self.members:
            node = self.levels[level][3]
            order = np.argsort(node, kind="stable")
            self.members[level] = order, np.searchsorted(node[order], np.arange(len(self.levels[level][0]) + 1))
        order, ends = self.members[level]
        first, n = ends[nodes], ends[nodes + 1] - ends[nodes]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(nodes)), n), order[at]

    def weights(self, level: int) -> np.ndarray:
        return self.weight if level < 0 else self.levels[level][4]


def _cos(a: Cell, i: np.ndarray, b: Cell, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", a.x[i[k : k + 65536]], b.x[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.empty(0)


def _meeting(a: Cell, b: Cell, far: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of top nodes within both radii and ``far``.

    cos(ra + rb + far) is a product of two-vectors, so one matrix product
    compares every pair with its own limit; radii too wide for that stay in.
    """
    (ca, ra), (cb, rb) = a.at(len(a.levels) - 1), b.at(len(b.levels) - 1)
    widest = (np.pi - far) / 2
    left = np.concatenate([a.x[ca], -np.cos(ra + far)[:, None], np.sin(ra + far)[:, None]], axis=1).astype(np.float32)
    right = np.concatenate([b.x[cb], np.cos(rb)[:, None], np.sin(rb)[:, None]], axis=1).astype(np.float32).T
    found = []
    for k in range(0, len(left), 512):
        hit = left[k : k + 512] @ right >= -1e-4
        hit[ra[k : k + 512] > widest] = True
        hit[:, rb > widest] = True
        i, j = np.nonzero(hit)
        found.append((i + k, j))
    return np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])


def dual_traversal(a: Cell, b: Cell, cosine: float) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """``level in a, nodes, level in b, nodes``: pairs of nodes of which every vector of one has ``cosine`` with every one of the other.

    Level -1 are the vectors themselves, compared exactly. Each pair of vectors
    comes once; a may be b, then in both orders, and each vector with itself.
    """
    far = float(angle(np.array(cosine)))
    i, j = _meeting(a, b, far)
    stack = [(i, j, len(a.levels) - 1, len(b.levels) - 1)]
    while stack:
        i, j, la, lb = stack.pop()
        (ca, ra), (cb, rb) = a.at(la), b.at(lb)
        cos = _cos(a, ca[i], b, cb[j])
        if la < 0 and lb < 0:
            exact = cos >= cosine
            yield la, i[exact], lb, j[exact]
            continue
        away, both = angle(cos), ra[i] + rb[j]
        whole = away + both <= far - 1e-6
        if whole.any():
            yield la, i[whole], lb, j[whole]
        near = ~whole & (away <= both + far + 1e-6)
        i, j = i[near], j[near]
        if not len(i):
            continue
        kids, turn = (a.levels[la][2], i) if la >= lb else (b.levels[lb][2], j)
        n = np.array([len(k) for k in kids])[turn]
        down = np.concatenate([kids[k] for k in turn])
        if la >= lb:
            i, j, la = down, np.repeat(j, n), la - 1
        else:
            i, j, lb = np.repeat(i, n), down, lb - 1
        for k in range(0, len(i), 1 << 20):
            stack.append((i[k : k + (1 << 20)], j[k : k + (1 << 20)], la, lb))


def links_between(a: Cell, b: Cell | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Per vector of a and then b: the weight it links with, and a label (a place) that vectors joined by links share. b None: within a."""
    other, shift = (a, 0) if b is None else (b, len(a.x))
    labels = _Labels(len(a.x) + (0 if b is None else len(b.x)))
    n = np.zeros(len(labels.of), np.int64)
    for la, i, lb, j in dual_traversal(a, other, cosine):
        sides = [(a, la, i, 0, other, lb, j, shift)]
        if b is not None:  # within one cell every pair comes in both orders
            sides.append((other, lb, j, shift, a, la, i, 0))
        for x, lx, nx, sx, y, ly, ny, sy in sides:
            some, at = np.unique(nx, return_inverse=True)
            gain = np.bincount(at, y.weights(ly)[ny]).astype(np.int64)
            node, vec = x.within(lx, some)
            n[vec + sx] += gain[node]
            node, vec = x.within(lx, nx)
            labels.add(vec + sx, y.at(ly)[0][ny][node] + sy)
    if b is None:
        n -= a.weight  # every vector met itself once
    return n, labels.of


class _Labels:
    """Components within a task, as labels of places."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            low = np.minimum(self.of[i], self.of[j])
            apart = self.of[i] != self.of[j]
            if not apart.any():
                return
            i, j, low = i[apart], j[apart], low[apart]
            target = np.arange(len(self.of))
            np.minimum.at(target, self.of[i], low)
            np.minimum.at(target, self.of[j], low)
            while not np.array_equal(t := target[target], target):
                target = t
            self.of = target[self.of]


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = 0.95,
    sample: int = 4096,
    nodes: int = 1024,
    cell: int | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Two vectors are linked if their cosine, in double precision, is ``cosine``
    or more. n_links counts other vectors linked directly, copies included;
    component_id is the smallest vec_id reachable by links; ``kept`` is true for it.

    NULL and zero vectors, and those with a NULL or non-finite component, link
    with nothing. Vectors of different lengths are never linked. vec_id must be
    an integer; rows that repeat one count as one more copy each; rows with a
    NULL vec_id are left out. An empty table gives an empty table; other columns are not read.

    Equal vectors are one weighted representative. ``sample`` bounds the
    vectors that upper nodes are fitted on and ``nodes`` their number; all
    vectors are indexed and compared. Cells hold about ``cell`` vectors
    (CELL_NUMBERS / length of a vector by default); a top node of a cell goes to
    those other cells alone that its bounds allow, with all its vectors, and each
    pair of cells that meets is a group, so no task grows with a hot node. Families
    within the threshold's angle are counted by their nodes, not in pairs. Vectors without clusters (all
    far from each other) leave no pair of upper nodes to drop: then every cell
    meets every other one, as in any exact method of this kind.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(embedding, lambda v: v != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(fine, F.lit(False)).alias("fine")).where("vec_id is not null")
    # -0.0 and 0.0 are one value here
    rows = rows.withColumn("v", F.when(F.col("fine"), F.transform("v", lambda c: c + F.lit(0.0))))
    rows = scratch.write(rows.select("vec_id", "v", "fine", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")))
    groups = rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min_by("v", "vec_id").alias("v"))
    groups = scratch.write(groups.withColumn("dim", F.size("v")))
    dims = groups.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per vector length
    links = [_links_of(groups.where(F.col("dim") == d["dim"]), d["n"], cosine, sample, nodes, cell, scratch) for d in dims]
    if not links:
        links = [spark.createDataFrame([], "rep long, n long, label long")]
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    found = scratch.write(found)
    reach = connected_components(found.select(F.col("rep").alias("a"), F.col("label").alias("b")), scratch)
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = groups.select("h1", "h2", "rep", "weight").join(counts, "rep", "left").join(reach, F.col("rep") == F.col("node"), "left")
    known = known.select("h1", "h2", "weight", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component"))
    linked = rows.where("fine").select("vec_id", "h1", "h2").join(known, ["h1", "h2"])
    linked = linked.select("vec_id", (F.col("n") + F.col("weight") - 1).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large and small values finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str], use) -> Iterator[pa.RecordBatch]:
    """What ``use(columns)`` returns for each run of equal keys, over batches; columns are arrays, lists become matrices."""
    now, held = None, []

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in columns}

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        own = {c: _matrix(batch.column(c)) if pa.types.is_list(batch.column(c).type) else batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
        for at, end in zip(edges, edges[1:]):
            if tuple(key[at]) != now:
                if held:
                    yield from use(now, joined())
                now, held = tuple(key[at]), []
            held.append({c: v[at:end].copy() for c, v in own.items()})
    if held:
        yield from use(now, joined())


def _links_of(groups: DataFrame, total: int, cosine: float, sample: int, nodes: int, cell: int | None, scratch: Scratch) -> DataFrame:
    """``rep, n, label``: per representative and pair of cells, its links and a member it is connected with."""
    spark = groups.sparkSession
    fitted = groups.orderBy("h1", "h2").limit(sample).select("v").toPandas()  # the digests are a random order
    x = _unit(np.stack(fitted.v))
    cell = cell or max(256, CELL_NUMBERS // x.shape[1])
    centres = x[farthest_first(x, min(nodes, max(1, total // cell)))]
    far = float(angle(np.array(cosine)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = _unit(_matrix(b.column("v")))
                cos = own @ centres.T
                node = cos.argmax(axis=1)
                away = angle(cos[np.arange(len(own)), node])
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("weight"), _lists(own), pa.array(node.astype(np.int32)), pa.array(away)], ["rep", "weight", "v", "node", "away"])

    dealt = scratch.write(groups.select("rep", "weight", "v").mapInArrow(assign, "rep long, weight long, v array<double>, node int, away double"))
    sizes = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()  # at most ``nodes`` rows
    cells = {r["node"]: -(-r["n"] // cell) for r in sizes}
    known = np.array(sorted(cells))
    reach = np.array([r["r"] for r in sorted(sizes, key=lambda r: r["node"])]) + far + 1e-6
    parts = F.element_at(F.create_map(*[F.lit(v) for k, n in cells.items() for v in (k, n)]), F.col("node"))
    keyed = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), parts).cast("int")).select("node", "own", "rep", "weight", "v")

    def grow(now, c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, n = c["v"], len(c["rep"])
        of = parents(x)
        top, at = np.unique(of[-1], return_inverse=True)
        radius = np.zeros(len(top))
        np.maximum.at(radius, at, angle(np.einsum("ij,ij->i", x, x[of[-1]])))
        meets = angle(x[top] @ centres[known].T) <= radius[:, None] + reach
        to = [known[m].astype(np.int32) for m in meets]
        for k in range(0, n, 2000):  # lists of other nodes may be long
            part = slice(k, min(n, k + 2000))
            arrays = [np.full(len(at[part]), v, np.int32) for v in now] + [np.arange(n, dtype=np.int32)[part], c["rep"][part], c["weight"][part]]
            others = pa.array([to[i] for i in at[part]], pa.list_(pa.int32()))
            levels = [pa.array(o[part].astype(np.int32)) for o in of]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), _lists(x[part]), *levels, others], names)

    names = ["node", "own", "place", "rep", "weight", "v", *(f"p{k}" for k in range(len(LEVELS))), "to"]
    levels = "".join(f", p{k} int" for k in range(len(LEVELS)))
    grown = keyed.repartition("node", "own").sortWithinPartitions("node", "own", "rep").mapInArrow(
        lambda it: _grouped(it, ["node", "own"], ["rep", "weight", "v"], grow),
        f"node int, own int, place int, rep long, weight long, v array<double>{levels}, to array<int>",
    )
    grown = scratch.write(grown)
    every = F.create_map(*[F.lit(v) for k, n in cells.items() for v in (k, n)])
    # one row for each cell that the vector's top node may meet
    others = F.flatten(F.transform("to", lambda t: F.transform(F.sequence(F.lit(0), F.element_at(every, t) - 1), lambda o: F.struct(t.alias("n"), o.alias("c")))))
    sent = grown.withColumn("o", F.explode(others))
    mine = F.struct(F.col("node").alias("n"), F.col("own").alias("c"))
    low, high = F.least(mine, F.col("o")), F.greatest(mine, F.col("o"))
    sent = sent.select(low["n"].alias("k0"), low["c"].alias("k1"), high["n"].alias("k2"), high["c"].alias("k3"), (mine > F.col("o")).alias("right"), *names[2:-1])
    key = ["k0", "k1", "k2", "k3"]
    sent = sent.repartition(*key).sortWithinPartitions(*key, "right", "place")

    def tree(c: dict[str, np.ndarray], rows: np.ndarray) -> Cell:
        place = c["place"][rows]
        return Cell(c["v"][rows], c["weight"][rows], [np.searchsorted(place, c[f"p{k}"][rows]) for k in range(len(LEVELS))])

    def compare(now, c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        right = c["right"].astype(bool)
        if now[:2] == now[2:]:
            n, label = links_between(tree(c, ~right), None, cosine)
        elif right.all() or not right.any():
            return
        else:
            n, label = links_between(tree(c, ~right), tree(c, right), cosine)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c["rep"][some]), pa.array(n[some]), pa.array(c["rep"][label[some]])], ["rep", "n", "label"])

    columns = ["right", "place", "rep", "weight", "v", *(f"p{k}" for k in range(len(LEVELS)))]
    return sent.mapInArrow(lambda it: _grouped(it, key, columns, compare), "rep long, n long, label long")
