"""Vectors: weighted centroids, medians, and pair similarity by bounded tiles.

Pair work never goes through a cross join and never writes the pairs out: rows are spread over blocks of bounded size, each
pair of blocks is one small task group (one matrix product), and a tile returns only what the caller wants of it (the
best k per row, a histogram, counts, or the pairs in a value range). The answers are exact."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinor.functions.binding import let
from affinor.operators.ranking import grouped_quantiles, top_k

BLOCK = 1024
WIDE = 32  # blocks that rows are dealt to, until such a block would hold more than
CELLS = 1 << 21  # numbers


# ------------------------------------------------------------------ column helpers
def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: str | Column) -> Column:
    def scaled(c: Column) -> Column:
        return let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(c, lambda x: F.try_divide(x, n)))
    return let(F.col(v) if isinstance(v, str) else v, scaled)


# ------------------------------------------------------------------ sums of vectors
def _partial_sums(cols: list[str]) -> Callable:
    """One pass over a partition's Arrow batches: running (key, sum, weight) per key, flushed when many keys are held."""
    def run(batches):
        acc: dict[tuple, np.ndarray] = {}
        wsum: dict[tuple, float] = {}

        def flush():
            keys = list(acc)
            arrays = [pa.array([k[i] for k in keys], type=pa.int64()) for i in range(len(cols))]
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.array([acc[k].tolist() for k in keys], type=pa.list_(pa.float64())),
                 pa.array([wsum[k] for k in keys], type=pa.float64())], names=[*cols, "s", "w"])
        for b in batches:
            if b.num_rows == 0:
                continue
            keys = list(zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in cols]))
            w = b.column(b.schema.get_field_index("w")).to_numpy(zero_copy_only=False)
            v = b.column(b.schema.get_field_index("v"))
            m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1) * w[:, None]
            uniq: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                uniq.setdefault(k, []).append(i)
            for k, idx in uniq.items():
                s = m[idx].sum(0)
                if k in acc:
                    acc[k] += s
                    wsum[k] += float(w[idx].sum())
                else:
                    acc[k], wsum[k] = s, float(w[idx].sum())
            if len(acc) > 4096:
                yield flush()
                acc.clear()
                wsum.clear()
        if acc:
            yield flush()
    return run


def unit_means(df: DataFrame, keys: Sequence[str], v: str = "v", weight: Column | None = None) -> DataFrame:
    """Unit-length weighted mean vector per (long) key, from partial sums built in the map tasks: a key with a third of
    all rows reaches the final aggregate as one partial vector per task. Keys without vectors give no row."""
    keys = list(keys)
    w = weight if weight is not None else F.lit(1.0)
    return vector_sums(df, keys, v, w).select(*keys, unit("v").alias("v"))


def vector_sums(df: DataFrame, keys: Sequence[str], v: str, weight: Column) -> DataFrame:
    """(keys, v): weighted sum of the vectors per (long) key."""
    keys = list(keys)
    src = df.filter(F.col(v).isNotNull()).select(*[F.col(k).cast("long").alias(k) for k in keys],
                                                 F.col(v).alias("v"), weight.cast("double").alias("w"))
    schema = ", ".join([f"{k} long" for k in keys] + ["s array<double>", "w double"])
    part = src.mapInArrow(_partial_sums(keys), schema)
    # exploding per dimension keeps the final sum a combinable aggregate of plain numbers
    dims = part.select(*keys, F.posexplode("s").alias("dim", "x")).groupBy(*keys, "dim").agg(F.sum("x").alias("x"))
    return (dims.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("l"))
            .select(*keys, F.transform("l", lambda e: e["x"]).alias("v")))


def citation_weight(cites: str = "cites") -> Column:
    return 1 + F.log1p(F.col(cites).cast("double"))


def entity_vectors(items: DataFrame, keys: Sequence[str] = ("entity",), weighted: bool = True) -> DataFrame:
    return unit_means(items, keys, weight=citation_weight() if weighted else None)


def median_centres(items: DataFrame, key: str = "entity") -> DataFrame:
    """Element-wise median vector per key, unit length."""
    dims = items.select(key, F.posexplode("v").alias("dim", "x"))
    med = grouped_quantiles(dims, [key, "dim"], "x", [0.5], bins=64)
    return (med.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "q0"))).alias("l"))
            .select(key, unit(F.transform("l", lambda e: e["q0"])).alias("centre")))


# ------------------------------------------------------------------ tiles
def _blocks(df: DataFrame, keys: list[str], size: int, wide: bool = False) -> DataFrame:
    """Spread rows over ceil(n / size) blocks per key, so no block grows with the data. Every row is sent once per block of the other side;
    `wide` blocks are larger, of at most CELLS numbers, but WIDE blocks if there are rows for them."""
    need = F.ceil(F.count("*") / F.lit(size))
    if wide:
        most = F.greatest(F.lit(size), F.floor(F.lit(CELLS) / F.greatest(F.lit(1), F.max(F.size("v")))))
        need = F.least(need, F.greatest(F.lit(WIDE), F.ceil(F.count("*") / most)))
    need = F.greatest(F.lit(1), need).cast("int")
    if keys:
        df = df.join(df.groupBy(*keys).agg(need.alias("_nb")), keys)
    else:
        df = df.withColumn("_nb", df.agg(need).scalar())
    return df.withColumn("_blk", F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int"))


class Tile:
    """Two stretches of a pair of blocks inside a task: ids, similarities (rounded to 9 places, so ties are ties in any summation order)
    and a mask of the pairs that count (never a row with itself). What is kept in `left_notes` and `right_notes` is there again when the task
    takes the same stretch to its next tile."""

    def __init__(self, left: tuple[pa.Table, np.ndarray, dict], right: tuple[pa.Table, np.ndarray, dict], same: bool, diagonal: bool):
        (self._l, self._a, self.left_notes), (self._r, self._b, self.right_notes) = left, right
        self.i, self.j = self._l.column("id").to_numpy(), self._r.column("id").to_numpy()
        self.same, self.diagonal = same, diagonal

    @cached_property
    def raw(self) -> np.ndarray:
        """Similarities before they are rounded."""
        return self._a @ self._b.T

    @cached_property
    def sim(self) -> np.ndarray:
        return np.round(self.raw, 9)

    @cached_property
    def apart(self) -> np.ndarray | None:
        """The pairs that are not a row with itself; none if all are."""
        return self.i[:, None] != self.j[None, :] if self.same else None

    @cached_property
    def ok(self) -> np.ndarray:
        return np.ones((len(self.i), len(self.j)), dtype=bool) if self.apart is None else self.apart

    def left(self, name: str) -> np.ndarray:
        return self._l.column(name).to_numpy()

    def right(self, name: str) -> np.ndarray:
        return self._r.column(name).to_numpy()

    def right_matrix(self) -> np.ndarray:
        return self._b

    def left_list(self, name: str) -> list:
        return self._l.column(name).to_pylist()

    def right_list(self, name: str) -> list:
        return self._r.column(name).to_pylist()

    def upper(self) -> np.ndarray:
        """Each unordered pair once."""
        return self.ok & (self.i[:, None] < self.j[None, :]) if self.diagonal else self.ok


def tile_map(left: DataFrame, fn: Callable[[Tile], dict[str, np.ndarray]], schema: str, keys: Sequence[str] = (),
             right: DataFrame | None = None, carry: Sequence[str] = (), block: int = BLOCK,
             merge: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]] | None = None) -> DataFrame:
    """Run `fn` on every tile. `left` (and `right`) have id long, v array<double>, the long `keys` and the columns to
    `carry` (null on a side that lacks one). Without `right` the tiles are the unordered block pairs of `left`
    with itself. A tile task holds at most about two blocks, however large a key is. `merge` joins what `fn` gave of several tiles
    into fewer rows of the same columns; with it a task takes wide blocks, tile by tile, and rows are sent to fewer tasks."""
    keys, carry = list(keys), list(carry)
    same = right is None
    wide = merge is not None
    sizes = _blocks(left, keys, block, wide)
    if same:
        src = (sizes.select(*keys, "id", "v", *carry, "_blk", F.lit(0).alias("_side"),
                            F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_other"))
               .withColumn("_a", F.least("_blk", "_other")).withColumn("_b", F.greatest("_blk", "_other")).drop("_other"))
    else:
        r = _blocks(right, keys, block, wide)
        if keys:
            lhs = sizes.join(r.groupBy(*keys).agg(F.max("_nb").alias("_rnb")), keys)
            rhs = r.join(sizes.groupBy(*keys).agg(F.max("_nb").alias("_lnb")), keys)
        else:
            lhs = sizes.withColumn("_rnb", r.agg(F.coalesce(F.max("_nb"), F.lit(1))).scalar())
            rhs = r.withColumn("_lnb", sizes.agg(F.coalesce(F.max("_nb"), F.lit(1))).scalar())
        types = {**dict(right.dtypes), **dict(left.dtypes)}
        lc, rc = ([F.col(c) if c in d.columns else F.lit(None).cast(types[c]).alias(c) for c in carry] for d in (left, right))
        lhs = lhs.select(*keys, "id", "v", *lc, "_blk", F.lit(0).alias("_side"), F.col("_blk").alias("_a"),
                         F.explode(F.sequence(F.lit(0), F.col("_rnb") - 1)).alias("_b"))
        rhs = rhs.select(*keys, "id", "v", *rc, "_blk", F.lit(1).alias("_side"), F.col("_blk").alias("_b"),
                         F.explode(F.sequence(F.lit(0), F.col("_lnb") - 1)).alias("_a"))
        src = lhs.unionByName(rhs)
    nk = len(keys)

    def stretches(t, rows):
        if wide:
            cuts = [t.filter(pa.array(rows)).slice(n, block) for n in range(0, int(rows.sum()), block)]
        else:
            cuts = [t.filter(pa.array(rows))]
        return [(c, c.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(c.num_rows, -1) if c.num_rows else np.zeros((0, 1)), {}) for c in cuts]

    def run(key, t):
        vals = [k.as_py() for k in key]
        a, b = vals[nk], vals[nk + 1]
        where = t.column("_blk" if same else "_side").to_numpy()
        left = stretches(t, where == (a if same else 0))
        right = left if same and a == b else stretches(t, where == (b if same else 1))
        out, rows = {c: np.zeros(0, dtype=d) for c, d in kinds.items()}, 0
        for x, l in enumerate(left):
            for y, r in enumerate(right):
                if (same and a == b and y < x) or not (len(l[1]) and len(r[1])):
                    continue
                # rows of one id are in one block
                got = fn(Tile(l, r, same and a == b, same and a == b and x == y))
                out = {c: np.concatenate([out[c], got[c]]) for c in out}
                if wide and len(next(iter(out.values()))) > 2 * rows + (1 << 16):  # merged when it has doubled
                    out = merge(out)
                    rows = len(next(iter(out.values())))
        if wide:
            out = merge(out)
        n = len(next(iter(out.values())))
        return pa.table({**{k: np.full(n, vals[i], dtype=np.int64) for i, k in enumerate(keys)}, **out})
    numbers = {"long": np.int64, "int": np.int32, "double": np.float64}
    kinds = {c: numbers[d] for c, d in (x.split() for x in schema.split(","))}
    full = ", ".join([f"{k} long" for k in keys] + [schema])
    return src.groupBy(*keys, "_a", "_b").applyInArrow(run, full)


def _k_best(k: int, *group: str) -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]:
    """Of the rows of each group, the k of largest sim; of equals, those with the smaller j."""
    def merge(out):
        o = np.lexsort((out["j"], -out["sim"], *(out[g] for g in group)))
        out = {c: x[o] for c, x in out.items()}
        n = len(o)
        new = np.zeros(n, dtype=bool)
        new[:1] = True
        for g in group:
            new[1:] |= out[g][1:] != out[g][:-1]
        start = np.flatnonzero(new)
        keep = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n])) < k
        return {c: x[keep] for c, x in out.items()}
    return merge


def _added(key: str, *numbers: str) -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]:
    """The sums of whole numbers per key."""
    def merge(out):
        u, at = np.unique(out[key], return_inverse=True)
        sums = {}
        for c in numbers:
            sums[c] = np.zeros(len(u), dtype=np.int64)
            np.add.at(sums[c], at, out[c])
        return {key: u, **sums}
    return merge


def _side(df: DataFrame, id: str, *cols: str) -> DataFrame:
    return df.select(F.col(id).cast("long").alias("id"), "v", *cols)


def _least(s: np.ndarray, k: int, axis: int) -> np.ndarray:
    """A number for every row (axis 1; 0: for every column) that at least k of its entries reach, if it has more than k: the k-th largest of its
    maxima over groups of entries."""
    n = s.shape[axis]
    if n <= k:
        return np.full(s.shape[1 - axis], -np.inf)
    groups = max(k, min(n, 64))
    wide = n // groups * groups
    if axis:
        top = np.fmax.reduce(s[:, :wide].reshape(len(s), -1, groups), axis=1)
    else:
        top = np.fmax.reduce(s[:wide].reshape(-1, groups, s.shape[1]), axis=0)
    low = -np.take(np.partition(-top, k - 1, axis=axis), k - 1, axis=axis)
    return np.where(np.isnan(low), -np.inf, low)


def _best(t: Tile, k: int, note: str, ok: np.ndarray | None = None, turned: bool = False, raw: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The k best columns of every row (or, `turned`, rows of every column); equal scores go to the smaller id. Those that cannot be among the k
    best any more, after what the task's tiles before have shown, are left out: `note` names where these k best are kept. `raw`
    takes the place of the tile's similarities."""
    raw = t.raw if raw is None else raw
    i, j, notes = (t.j, t.i, t.right_notes) if turned else (t.i, t.j, t.left_notes)
    seen = notes.setdefault(note, np.full((len(i), k), -np.inf))
    least = seen.min(1)
    if np.isneginf(least).any():
        s = raw if ok is None else np.where(ok, raw, -np.inf)
        least = np.fmax(least, np.round(_least(s, k, 0 if turned else 1), 9))
    # rounding moves a number by at most half of the last place
    hit = raw >= ((least - 1e-9)[None, :] if turned else (least - 1e-9)[:, None])
    if ok is not None:
        hit &= ok
    x, y = np.divmod(np.flatnonzero(hit.ravel()), hit.shape[1])
    v = np.round(raw[x, y], 9)
    r, c = (y, x) if turned else (x, y)
    keep = (v >= least[r]) & (v > -np.inf)
    r, c, v = r[keep], c[keep], v[keep]
    o = np.lexsort((j[c], -v, r))
    r, c, v = r[o], c[o], v[o]
    start = np.r_[0, np.flatnonzero(np.diff(r)) + 1] if len(r) else np.zeros(0, dtype=int)
    place = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    keep = place < k
    r, c, v, place = r[keep], c[keep], v[keep], place[keep]
    new = np.full(seen.shape, -np.inf)
    new[r, place] = v
    notes[note] = -np.partition(-np.hstack([seen, new]), k - 1, axis=1)[:, :k]
    return i[r], j[c], v


def top_neighbours(vectors: DataFrame, k: int, keys: Sequence[str] = (), id: str = "entity", block: int = BLOCK) -> DataFrame:
    """(keys, i, j, sim, rank): the k most similar other rows of every row. Ties go to the smaller id."""
    cand = tile_map(_side(vectors, id, *keys), _neighbour_rows(k, False), "kind int, i long, j long, sim double", keys, block=block, merge=_k_best(k, "kind", "i"))
    return top_k(cand.drop("kind"), [*keys, "i"], [F.col("sim").desc(), F.col("j")], k)


def neighbours_and_bridges(vectors: DataFrame, k: int, id: str = "entity", block: int = BLOCK) -> DataFrame:
    """(kind, i, j, sim, rank) from one pass over the tiles: kind 0 = the k nearest rows, kind 1 = the nearest row whose
    field `mask` has nothing in common."""
    cand = tile_map(_side(vectors, id, "mask"), _neighbour_rows(k, True), "kind int, i long, j long, sim double",
                    carry=["mask"], block=block, merge=_k_best(k, "kind", "i"))
    best = top_k(cand, ["kind", "i"], [F.col("sim").desc(), F.col("j")], k)
    return best.filter((F.col("kind") == 0) | (F.col("rank") == 1))


def _neighbour_rows(k: int, bridges: bool) -> Callable[[Tile], dict[str, np.ndarray]]:
    def fn(t: Tile):
        jobs = [(0, k, t.apart)]
        if bridges:
            other = (t.left("mask")[:, None] & t.right("mask")[None, :]) == 0
            jobs.append((1, 1, other if t.apart is None else t.apart & other))
        out = []
        for kind, n, ok in jobs:
            found = [_best(t, n, f"best{kind}", ok)]
            if not t.diagonal:
                found.append(_best(t, n, f"best{kind}", ok, turned=True))
            out += [(np.full(len(i), kind, dtype=np.int32), i, j, s) for i, j, s in found]
        return dict(zip(("kind", "i", "j", "sim"), (np.concatenate(c) for c in zip(*out))))
    return fn


def _skipped(t: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the pairs of a tile that the left rows' `skip` lists name."""
    if "skip" not in t.left_notes:
        lists = [[y for y in x or () if y is not None] for x in t.left_list("skip")]
        t.left_notes["skip"] = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([y for x in lists for y in x], dtype=np.int64)
    if "order" not in t.right_notes:
        t.right_notes["order"] = np.argsort(t.j, kind="stable")
    (row, id), order = t.left_notes["skip"], t.right_notes["order"]
    ids = t.j[order]
    low, high = np.searchsorted(ids, id, "left"), np.searchsorted(ids, id, "right")
    n = high - low
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return np.repeat(row, n), order[at]


def top_matches(queries: DataFrame, targets: DataFrame, k: int, disjoint: bool = False, block: int = BLOCK) -> DataFrame:
    """(i, j, sim, rank): the k best targets of every query vector. Both sides: id, v (and mask); queries may carry
    `skip`, a short list of target ids to leave out."""
    carry = (["mask"] if disjoint else []) + (["skip"] if "skip" in queries.columns else [])

    def fn(t: Tile):
        ok = None
        if disjoint:
            ok = (t.left("mask")[:, None] & t.right("mask")[None, :]) == 0
        if "skip" in carry:
            r, c = _skipped(t)
            if len(r):
                ok = np.ones(t.raw.shape, dtype=bool) if ok is None else ok
                ok[r, c] = False
        i, j, s = _best(t, k, "best", ok)
        return {"i": i, "j": j, "sim": s}
    cand = tile_map(queries.select("id", "v", *carry), fn, "i long, j long, sim double", right=targets, carry=carry, block=block, merge=_k_best(k, "i"))
    return top_k(cand, ["i"], [F.col("sim").desc(), F.col("j")], k)


def pairs_at_least(vectors: DataFrame, min_sim: float, id: str = "entity", block: int = BLOCK) -> DataFrame:
    """Unordered pairs with similarity >= min_sim; nothing below it leaves a tile."""
    def fn(t: Tile):
        r, c = np.nonzero(t.upper() & (t.sim >= min_sim))
        return {"i": np.minimum(t.i[r], t.j[c]), "j": np.maximum(t.i[r], t.j[c]), "sim": t.sim[r, c]}
    return tile_map(_side(vectors, id), fn, "i long, j long, sim double", block=block)


def scores_above(queries: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, above): how many targets score higher against each query than the query's own `floor`; target `own` is left out."""
    def fn(t: Tile):
        ok = t.ok & (t.left("own")[:, None] != t.j[None, :])
        return {"i": t.i, "above": (ok & (t.sim > t.left("floor")[:, None])).sum(1).astype(np.int64)}
    return (tile_map(queries, fn, "i long, above long", right=targets, carry=["own", "floor"], block=block, merge=_added("i", "above"))
            .groupBy("i").agg(F.sum("above").alias("above")))


HIST = 1 << 15


def _bin(sim: np.ndarray, bins: int = HIST) -> np.ndarray:
    return np.clip(((sim + 1.0) * (bins / 2)).astype(np.int64), 0, bins - 1)


def _bin_col(c: str, bins: int = HIST) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(c) + 1.0) * (bins / 2)))).cast("long")


def pair_ranks(vectors: DataFrame, values: DataFrame, id: str = "entity", block: int = BLOCK) -> DataFrame:
    """(value, below, total): for the few values in the one-row, one-column array frame `values`, the number of unordered
    pairs with a smaller similarity."""
    def fn(t: Tile):
        vals = np.array(t.left_list("vals")[0])
        s = np.sort(t.sim[t.upper()])
        return {"value": vals, "below": np.searchsorted(s, vals).astype(np.int64),
                "total": np.full(len(vals), len(s), dtype=np.int64)}
    src = _side(vectors, id).withColumn("vals", values.scalar())
    return (tile_map(src, fn, "value double, below long, total long", carry=["vals"], block=block, merge=_added("value", "below", "total"))
            .groupBy("value").agg(F.sum("below").alias("below"), F.sum("total").alias("total")))


def pair_median(vectors: DataFrame, within: Sequence[str] = (), id: str = "entity", block: int = BLOCK) -> DataFrame:
    """Exact lower and upper median over all pair similarities (only pairs that agree on `within`): one row n, lo, hi.

    The first pass counts pairs per histogram bin; the second sends out only the pairs in the one or two bins that hold
    the middle ranks, merged by value."""
    keys, gk = list(within), ["_one"]
    one = F.lit(1).cast("long").alias("_one")

    def count(t: Tile):
        u, n = np.unique(_bin(t.sim[t.upper()]), return_counts=True)
        return {"bin": u.astype(np.int64), "c": n.astype(np.int64)}
    hist = (tile_map(_side(vectors, id, *keys), count, "bin long, c long", keys, block=block, merge=_added("bin", "c"))
            .groupBy("bin").agg(F.sum("c").alias("c")).select(one, "bin", "c"))
    want, bins = _middle_bins(hist, gk)
    lim = bins.agg(F.struct(F.min("bin").alias("b0"), F.max("bin").alias("b1")))

    def emit(t: Tile):
        b, b0, b1 = _bin(t.sim), t.left("b0")[0], t.left("b1")[0]
        u, n = np.unique(t.sim[t.upper() & ((b == b0) | (b == b1))], return_counts=True)
        return {"s": u, "m": n.astype(np.int64)}
    src = _side(vectors, id, *keys).withColumn("_l", lim.scalar()).select("*", "_l.b0", "_l.b1")
    vals = tile_map(src, emit, "s double, m long", keys, carry=["b0", "b1"], block=block, merge=_added("s", "m"))
    vals = vals.groupBy("s").agg(F.sum("m").alias("m")).select(one, "s", "m")
    return _middle_values(want, bins, vals, gk, HIST).drop("_one")


def _middle_bins(hist: DataFrame, gk: list[str]) -> tuple[DataFrame, DataFrame]:
    """The middle ranks of every key and the histogram bins that hold them (at most one row per bin and key)."""
    cum = Window.partitionBy(*gk).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("upto", F.sum("c").over(cum)).withColumn("start", F.col("upto") - F.col("c"))
    want = h.groupBy(*gk).agg(F.max("upto").alias("n")).select(
        *gk, "n", F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("r"))
    bins = (want.join(h.select(*gk, "bin", "start", "upto"), gk)
            .filter((F.col("r") >= F.col("start")) & (F.col("r") < F.col("upto"))))
    return want, bins


def _middle_values(want: DataFrame, bins: DataFrame, vals: DataFrame, gk: list[str], width: int) -> DataFrame:
    vals = vals.withColumn("bin", _bin_col("s", width))
    run = Window.partitionBy(*gk, "bin").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    vals = (vals.join(bins.select(*gk, "bin", "start").distinct(), [*gk, "bin"])
            .withColumn("e", F.col("start") + F.sum("m").over(run)).withColumn("s0", F.col("e") - F.col("m")))
    hit = (want.join(vals.select(*gk, "s", "s0", "e"), gk)
           .filter((F.col("r") >= F.col("s0")) & (F.col("r") < F.col("e"))))
    return hit.groupBy(*gk, "n").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))


ROW_BINS = 256


def row_medians(vectors: DataFrame, key: str, id: str = "item", block: int = 2 * BLOCK) -> DataFrame:
    """(key, i, med): the median similarity of every row to all rows of its key, itself included.

    A key that fits one block is answered inside its single tile. A larger key is counted per row in 256 bins first and
    then only the values of the row's middle bins travel, so the full similarity rows never do."""
    src = _side(vectors, id, key)
    n = src.groupBy(key).agg(F.count("*").alias("_n"))
    src = src.join(n, key)

    def direct(t: Tile):
        return {"i": t.i, "med": np.median(t.sim, axis=1)}
    small = tile_map(src.filter(F.col("_n") <= block).drop("_n"), direct, "i long, med double", [key], block=block)
    big = src.filter(F.col("_n") > block).drop("_n")

    def both(t: Tile):
        yield t.i, t.sim
        if not t.diagonal:
            yield t.j, t.sim.T

    def count(t: Tile):
        out = []
        for ids, s in both(t):
            cell, c = np.unique(np.arange(len(ids))[:, None] * ROW_BINS + _bin(s, ROW_BINS), return_counts=True)
            out.append((ids[cell // ROW_BINS], cell % ROW_BINS, c))
        i, b, c = (np.concatenate(x) for x in zip(*out))
        return {"i": i, "bin": b.astype(np.int64), "c": c.astype(np.int64)}
    gk = [key, "i"]
    hist = tile_map(big, count, "i long, bin long, c long", [key], block=block).groupBy(*gk, "bin").agg(F.sum("c").alias("c"))
    want, bins = _middle_bins(hist, gk)
    lim = bins.groupBy(*gk).agg(F.min("bin").alias("b0"), F.max("bin").alias("b1")).withColumnRenamed("i", "id")

    def emit(t: Tile):
        out = []
        for (ids, s), side in zip(both(t), (t.left, t.right)):
            b = _bin(s, ROW_BINS)
            r, c = np.nonzero((b == side("b0")[:, None]) | (b == side("b1")[:, None]))
            out.append((ids[r], s[r, c]))
        i, s = (np.concatenate(x) for x in zip(*out))
        return {"i": i, "s": s}
    vals = (tile_map(big.join(lim, [key, "id"]), emit, "i long, s double", [key], carry=["b0", "b1"], block=block)
            .groupBy(*gk, "s").agg(F.count("*").alias("m")))
    large = _middle_values(want, bins, vals, gk, ROW_BINS).select(*gk, ((F.col("lo") + F.col("hi")) / 2).alias("med"))
    return small.unionByName(large)


def medoid_similarity(vectors: DataFrame, key: str, id: str = "item", block: int = 2 * BLOCK) -> DataFrame:
    """(key, id, sim): similarity of every row to its key's medoid, the row with the largest median similarity."""
    med = row_medians(vectors, key, id, block)
    best = (med.groupBy(key).agg(F.max_by("i", F.struct(F.round("med", 9), -F.col("i"))).alias(id))
            .join(vectors.select(key, id, F.col("v").alias("_m")), [key, id]).drop(id))
    return vectors.join(best, key).withColumn("sim", F.round(dot("v", "_m"), 9)).drop("_m")


# ------------------------------------------------------------------ graph of neighbours
def undirected(topk: DataFrame) -> DataFrame:
    """Pair kept when either end lists the other; ordered ends, once each."""
    return (topk.groupBy(F.least("i", "j").alias("source"), F.greatest("i", "j").alias("target"))
            .agg(F.max("sim").alias("sim")))


def similarity_edges(knn: DataFrame, bridges: DataFrame, threshold: DataFrame) -> DataFrame:
    """Neighbour pairs at or above the threshold, plus bridge pairs at or above it that are not shown already."""
    cut = threshold.scalar()
    shown = knn.withColumn("_t", cut).filter(F.col("sim") >= F.col("_t")).drop("_t").withColumn("bridge", F.lit(False))
    extra = (bridges.withColumn("_t", cut).filter(F.col("sim") >= F.col("_t")).drop("_t")
             .join(shown, ["source", "target"], "left_anti").withColumn("bridge", F.lit(True)))
    return shown.unionByName(extra)


def band_cuts(edges: DataFrame) -> DataFrame:
    """1/3 and 2/3 quantiles of the edge weights per group, and over all edges."""
    q = grouped_quantiles(edges, ["grp"], "sim", [1 / 3, 2 / 3])
    a = grouped_quantiles(edges, [], "sim", [1 / 3, 2 / 3]).withColumn("grp", F.lit("all"))
    return q.unionByName(a).select("grp", F.round("q0", 4).alias("lo"), F.round("q1", 4).alias("hi"))


def band(weight: Column, lo: Column, hi: Column, threshold: Column) -> Column:
    return (F.when(weight < threshold, "distant").when(weight >= hi, "upper").when(weight >= lo, "middle").otherwise("lower"))


def with_bands(edges: DataFrame, cuts: DataFrame, threshold: DataFrame, weight: str = "sim") -> DataFrame:
    """Band of each edge by its group's cuts; a group without cuts uses those of all edges. One row per group in `cuts`."""
    own = cuts.filter("grp <> 'all'")
    whole = cuts.filter("grp = 'all'")
    return (edges.join(own, "grp", "left")
            .withColumn("lo", F.coalesce("lo", whole.select("lo").scalar()))
            .withColumn("hi", F.coalesce("hi", whole.select("hi").scalar()))
            .withColumn("_t", threshold.scalar())
            .withColumn("band", band(F.col(weight), F.col("lo"), F.col("hi"), F.col("_t"))).drop("lo", "hi", "_t"))


# ------------------------------------------------------------------ int8 form
def quantize_int8(vectors: DataFrame, v: str = "v") -> DataFrame:
    """round(x / M * 127) with M the largest absolute component of the table."""
    biggest = vectors.agg(F.max(F.array_max(F.transform(v, F.abs)))).scalar()
    return vectors.withColumn("_m", biggest).withColumn(
        "q", F.transform(v, lambda x: F.round(x / F.col("_m") * 127).cast("tinyint"))).drop("_m")


def dequantize_unit(q: str | Column) -> Column:
    return unit(F.transform(q, lambda x: x.cast("double")))
