"""Exact density clusters with memory and disk linear in the rows.

Different vectors are packed into blocks, in the folder that all executors share, and never shuffled; a task keeps one block and reads the others
one after the other. Products find the pairs that may count, differences measure them.

1. Every point's nearest others give its core distance and the spanning forest of their links.
2. While that forest has several parts, a pass finds each point's least link to another part (so a part's too, as Boruvka's method needs).
3. Points are written in the order of the tree's leaves, so that the greatest weight between two points, which a better link must undercut, is a
   maximum over an interval. A pass over all pairs emits the links that do, and the tree of both is the minimum spanning tree.

Equal weights go by the rows' ids, so the tree is that of ``cluster.spanning_tree``. Equal vectors are one point with a count, told by 128 bits
of their BLAKE2b digests; points are numbered in the order of their first rows' ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, fresh_path
from .cluster import tree_labels

#: Rows of a block whose products with another block are held at a time, pairs measured at a time, links of a task that are held.
_ROWS, _PAIRS, _LINKS = 256, 1 << 15, 1 << 21
#: Error of products in single precision, as a part of the distances that count.
_ROUGH = 1e-3
#: Rows of one block, as a multiple of its points.
_COPIES = 16
#: Least points of a block, where there are too few rows for larger blocks on all cores.
_LEAST = 512

Files = list[tuple[str, int]]  # of blocks: address and number of points


def _read(uri: str, *columns: str) -> list:
    system, path = pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    with system.open_input_file(path) as file:
        row = pa.parquet.ParquetFile(file).read(list(columns)).to_pylist()[0]
    return [row[c] for c in columns]


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _floats(data: bytes) -> np.ndarray:
    return np.frombuffer(data, float)


def _vectors(uri: str, points: int, dtype: str) -> np.ndarray:
    return np.frombuffer(_read(uri, "v")[0], dtype).reshape(points, -1).astype(float)


def _write(df: DataFrame, label: str) -> tuple[str, list]:
    """The path, and of each row its address, ``block`` and ``points``; a row a file."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", 1).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path).select(F.input_file_name().alias("uri"), "block", "points").collect()
    return path, sorted(found, key=lambda r: (r["block"], r["uri"]))


def _each(spark: SparkSession, tasks: int, work: Callable[[int], dict], schema: str) -> DataFrame:
    """A task and a row for each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch["id"].to_pylist():
                yield pa.RecordBatch.from_pydict({k: [v.tobytes() if isinstance(v, np.ndarray) else v] for k, v in work(i).items()}, wanted)

    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    wanted = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])
    return spark.range(0, tasks, 1, tasks).mapInArrow(run, schema)


def _pack(batches: Iterator[pa.RecordBatch], dtype: str, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ``size`` different vectors; of each row its id, whether that is null, and its vector's place (-1 if not finite)."""
    index, points, ids, nulls, owners, width = {}, [], [], [], [], -1

    def block() -> pa.RecordBatch:
        row = {"block": 0, "points": len(points), "width": width, "rows": len(ids), "v": b"".join(points), "digests": b"".join(blake2b(p, digest_size=16).digest() for p in points), "ids": np.array(ids, np.int64).tobytes(), "nulls": np.array(nulls, bool).tobytes(), "owners": np.array(owners, np.int64).tobytes()}
        out = pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int32()), ("points", pa.int32()), ("width", pa.int32()), ("rows", pa.int32()), ("v", pa.binary()), ("digests", pa.binary()), ("ids", pa.binary()), ("nulls", pa.binary()), ("owners", pa.binary())]))
        for x in (index, points, ids, nulls, owners):
            x.clear()
        return out

    for batch in batches:
        if not len(batch):
            continue
        widths = np.unique(pa.compute.list_value_length(batch["v"]).to_numpy(zero_copy_only=False))
        if len(widths) > 1 or width not in (-1, widths[0]):
            raise ValueError("vectors of different lengths")
        width = int(widths[0])
        x = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(batch), width) + np.zeros((), dtype)  # no -0.0
        finite = np.isfinite(x).all(1).tolist()
        for i, key in enumerate(batch["id"].to_pylist()):
            place = -1
            if finite[i]:
                value = x[i].tobytes()
                place = index.setdefault(value, len(points))
                if place == len(points):
                    points.append(value)
            ids.append(key or 0)
            nulls.append(key is None)
            owners.append(place)
            if len(points) == size or len(ids) == size * _COPIES:
                yield block()
    if ids:
        yield block()


def _distinct(_: int, files: Files) -> dict:
    """``source`` and number of rows of each point; and of all rows in the order of their ids, those without a point last: id, whether it is null,
    and point. ``first`` has the place in that order of each point's first row."""
    ids, nulls, owners, digests, base = [], [], [], [], 0
    for uri, points in files:
        i, z, o, g = _read(uri, "ids", "nulls", "owners", "digests")
        ids.append(_ints(i))
        nulls.append(np.frombuffer(z, bool))
        owners.append(np.where(_ints(o) >= 0, _ints(o) + base, -1))
        digests.append(_ints(g).reshape(-1, 2))
        base += points
    ids, nulls, owners, digests = (np.concatenate(x) for x in (ids, nulls, owners, digests))
    by = np.lexsort((digests[:, 1], digests[:, 0]))
    group = np.empty(base, np.int64)
    group[by] = np.cumsum(np.concatenate([[False], (digests[by][1:] != digests[by][:-1]).any(1)])[:base])
    rank = np.lexsort((ids, ~nulls, owners < 0))
    ids, nulls, owners = ids[rank], nulls[rank], owners[rank]
    owners = np.concatenate([group[owners[owners >= 0]], owners[owners < 0]])
    total, n = int((owners >= 0).sum()), int(group.max(initial=-1)) + 1
    first, source, number = np.full(n, total), np.full(n, base), np.empty(n, np.int64)
    np.minimum.at(first, owners[:total], np.arange(total))
    np.minimum.at(source, group, np.arange(base))
    by = np.argsort(first)
    number[by] = np.arange(n)
    owners[:total] = number[owners[:total]]
    return {"block": 0, "points": n, "source": source[by], "counts": np.bincount(owners[:total], minlength=n), "first": first[by], "ids": ids, "nulls": nulls, "owners": owners}


def forest(n: int, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(w, a, b) of the minimum spanning forest, in order, and the part of each of n points; a < b, equal weights go by (a, b)."""
    at = np.lexsort((b, a, w))
    w, a, b = w[at], a[at], b[at]
    part, kept = np.arange(n), np.zeros(len(w), bool)
    left, x, y = np.arange(len(w)), a, b
    while len(left):
        least = np.full(n, len(w))
        np.minimum.at(least, x, left)
        np.minimum.at(least, y, left)
        owns = np.flatnonzero(least < len(w))
        kept[least[owns]] = True
        to = np.arange(n)
        ends = part[a[least[owns]]], part[b[least[owns]]]
        to[owns] = np.where(ends[0] == owns, ends[1], ends[0])
        back = (to[to] == np.arange(n)) & (np.arange(n) < to)
        to[back] = np.flatnonzero(back)
        while (to[to] != to).any():
            to = to[to]
        part = to[part]
        x, y = part[a[left]], part[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
    return w[kept], a[kept], b[kept], part


def _products(own: np.ndarray, other: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Two matrices whose product has all squared distances, and a bound of its error; in single precision if that is small beside ``scale``."""
    x, y = (own**2).sum(1), (other**2).sum(1)
    most = float(x.max() + y.max())
    left, right = np.column_stack([own, x, np.ones(len(x))]), np.column_stack([-2 * other, np.ones(len(y)), y]).T.copy()
    rough = (own.shape[1] + 16) * 1.3e-7 * most
    if rough <= _ROUGH * scale < np.inf and 1e-30 < most < 1e30:
        return left.astype(np.float32), right.astype(np.float32), rough
    return left, right, (own.shape[1] + 16) * 1e-15 * most


def _limits(values: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The values in the precision of products, none below itself."""
    return values if kind == float else np.nextafter(values.astype(kind), np.array(np.inf, kind))


def _distances(own: np.ndarray, other: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(r))
    for s in range(0, len(r), _PAIRS):
        gap = own[r[s : s + _PAIRS]] - other[c[s : s + _PAIRS]]
        out[s : s + _PAIRS] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _others(i: int, files: Files) -> Iterator[tuple[int, int]]:
    """Number and first point of each block, block i first, then those after it, then those before it."""
    base = np.concatenate([[0], np.cumsum([points for _, points in files])]).tolist()
    for j in [*range(i, len(files)), *range(i)]:
        yield j, base[j]


def _nearest(i: int, files: Files, dtype: str, rows: str, k: int, wide: int) -> dict:
    """Of each point of block i its core distance and its ``wide`` nearest points, itself included."""
    n = files[i][1]
    own = _vectors(*files[i], dtype)
    counts = _ints(_read(rows, "counts")[0])
    near, which, count = np.full((n, wide), np.inf), np.full((n, wide), -1), np.zeros((n, wide), np.int64)
    for j, base in _others(i, files):
        other = own if j == i else _vectors(*files[j], dtype)
        copies = counts[base : base + len(other)]
        x, y, slack = _products(own, other, float(np.median(near[:, -1])) ** 2)
        for s in range(0, n, _ROWS):
            d2 = x[s : s + _ROWS] @ y
            most = near[s : s + _ROWS, -1] ** 2
            if len(other) > wide and np.isinf(most).any():
                most = np.minimum(most, np.partition(d2, wide - 1, axis=1)[:, wide - 1] + slack)
            r, c = np.divmod(np.flatnonzero(~(d2 > _limits(most[:, None] + slack, d2.dtype))), len(other))
            if not len(r):
                continue
            r += s
            d = _distances(own, other, r, c)
            own_rows = np.unique(r)
            at = np.concatenate([np.repeat(own_rows, wide), r])
            d, p, m = (np.concatenate([x[own_rows].ravel(), z]) for x, z in ((near, d), (which, base + c), (count, copies[c])))
            by = np.lexsort((p, d, p < 0, at))
            at, d, p, m = at[by], d[by], p[by], m[by]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            keep = place < wide
            near[at[keep], place[keep]], which[at[keep], place[keep]], count[at[keep], place[keep]] = d[keep], p[keep], m[keep]
    enough = np.cumsum(count, 1) >= k
    core = near[np.arange(n), np.where(enough.any(1), enough.argmax(1), wide - 1)]
    return {"block": i, "points": n, "core": core, "near": near, "which": which}


def _linked(_: int, files: Files, strips: list[str], wide: int) -> dict:
    """The spanning forest of the links to nearest points."""
    n = sum(points for _, points in files)
    core = np.concatenate([_floats(_read(uri, "core")[0]) for uri in strips])
    tree, held, base = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
    for uri, (_, points) in zip(strips, files):
        near, which = _read(uri, "near", "which")
        d, p, o = _floats(near), _ints(which), np.repeat(np.arange(base, base + points), wide)
        base += points
        d, p, o = (x[(p >= 0) & (p != o)] for x in (d, p, o))
        held.append((np.maximum(d, np.maximum(core[p], core[o])), np.minimum(p, o), np.maximum(p, o)))
        if sum(len(x[0]) for x in held) > max(_LINKS, 2 * n):
            tree, held = forest(n, *(np.concatenate(x) for x in zip(tree, *held)))[:3], []
    return _state(core, *(np.concatenate(x) for x in zip(tree, *held)))


def _state(core: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    """A row with the forest of these links; ``points`` counts its parts."""
    w, a, b, part = forest(len(core), w, a, b)
    names, part = np.unique(part, return_inverse=True)
    order, gap = _leaves(len(core), a, b) if len(names) == 1 else (np.zeros(0, np.int64),) * 2
    return {"block": 0, "points": len(names), "core": core, "part": part.astype(np.int64), "w": w, "a": a, "b": b, "order": order, "gap": gap}


def _leaves(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points in the order of the tree's leaves, and the last link that joins each with the next."""
    root, head, last, following, gap = list(range(n)), list(range(n)), list(range(n)), [-1] * n, [-1] * n

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    size = [1] * n
    for e, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        x, y = (x, y) if size[x] >= size[y] else (y, x)
        following[last[x]], gap[last[x]] = head[y], e
        root[y], last[x] = x, last[y]
        size[x] += size[y]
    out, x = [], head[top(0)]
    while x >= 0:
        out.append(x)
        x = following[x]
    order = np.array(out, np.int64)
    return order, np.array(gap, np.int64)[order]


def _least(i: int, files: Files, dtype: str, state: str) -> dict:
    """Of each point of block i the least link to another part of the forest."""
    core, part = _read(state, "core", "part")
    core, part = _floats(core), _ints(part)
    begin, n = sum(points for _, points in files[:i]), files[i][1]
    own, mine = _vectors(*files[i], dtype), part[begin : begin + n]
    best, ends = np.full(n, np.inf), np.full((n, 2), len(part))
    for j, base in _others(i, files):
        theirs = part[base : base + files[j][1]]
        same = (theirs == theirs[0]).all()
        if same and (mine == theirs[0]).all():
            continue
        other = own if j == i else _vectors(*files[j], dtype)
        x, y, slack = _products(own, other, float(np.median(best)) ** 2)
        for s in range(0, n, _ROWS):
            parts, limit = mine[s : s + _ROWS], best[s : s + _ROWS] ** 2
            if same and (parts == theirs[0]).all():
                continue
            d2 = x[s : s + _ROWS] @ y
            np.copyto(d2, np.inf, where=parts[:, None] == theirs[None])
            limit = np.minimum(limit, np.maximum.reduce([d2.min(1), core[begin + s : begin + s + len(d2)] ** 2, core[base + d2.argmin(1)] ** 2]) + slack)
            r, c = np.divmod(np.flatnonzero(~(d2 > _limits(limit[:, None] + slack, d2.dtype))), len(other))
            r, c = (z[parts[r] != theirs[c]] for z in (r, c))
            if not len(r):
                continue
            r += s
            p, q = begin + r, base + c
            w = np.maximum(_distances(own, other, r, c), np.maximum(core[p], core[q]))
            rows = np.unique(r)
            w, at, a, b = np.concatenate([w, best[rows]]), np.concatenate([r, rows]), np.concatenate([np.minimum(p, q), ends[rows, 0]]), np.concatenate([np.maximum(p, q), ends[rows, 1]])
            by = np.lexsort((b, a, w, at))
            by = by[np.searchsorted(at[by], rows)]
            best[rows], ends[rows, 0], ends[rows, 1] = w[by], a[by], b[by]
    known = ends[:, 1] < len(part)
    return {"block": i, "points": int(known.sum()), "w": best[known], "a": ends[known, 0], "b": ends[known, 1]}


def _joined(_: int, state: str, found: list[str]) -> dict:
    """The forest of a state, after a pass's links."""
    core, *tree = _read(state, "core", "w", "a", "b")
    new = [_read(uri, "w", "a", "b") for uri in found]
    w, a, b = (np.concatenate([kind(x) for x in column]) for kind, column in zip((_floats, _ints, _ints), zip(tree, *new)))
    return _state(_floats(core), w, a, b)


def _gather(i: int, files: Files, dtype: str, state: str, column: str, size: int) -> dict:
    """Block i of the points in the order of a column of ``state``."""
    wanted = _ints(_read(state, column)[0])[i * size : (i + 1) * size]
    base, out = 0, None
    for uri, points in files:
        here = np.flatnonzero((wanted >= base) & (wanted < base + points))
        if len(here):
            v = np.frombuffer(_read(uri, "v")[0], dtype).reshape(points, -1)
            out = np.empty((len(wanted), v.shape[1]), dtype) if out is None else out
            out[here] = v[wanted[here] - base]
        base += points
    return {"block": i, "points": len(wanted), "v": out}


def _better(i: int, files: Files, dtype: str, rows: str, state: str, size: int) -> dict:
    """Links of block i with itself and later blocks that come before the last link between their ends in the tree; and of each point of several
    rows the first point before it that it reaches at its core distance: its other rows' link."""
    core, order, gap, w, a, b = (kind(x) for kind, x in zip((_floats, _ints, _ints, _floats, _ints, _ints), _read(state, "core", "order", "gap", "w", "a", "b")))
    n, own = files[i][1], _vectors(*files[i], dtype)
    many, low = _ints(_read(rows, "counts")[0]) > 1, np.arange(len(order))
    begin, end = i * size, i * size + n
    tail = np.maximum.accumulate(gap[begin:end][::-1])[::-1]
    held, between = [], -1
    for j in range(i, len(files)):
        start = j * size
        other = own if j == i else _vectors(*files[j], dtype)
        into = np.maximum.accumulate(np.concatenate([[-1], gap[start : start + len(other) - 1]]))
        from_ = np.maximum(tail, between)
        x, y, slack = _products(own, other, np.inf if j == i else float(np.median(w[from_])) ** 2)
        limit, into_limit = (_limits(z + slack, x.dtype) for z in (w[from_] ** 2, np.where(into >= 0, w[into] ** 2, -np.inf)))
        for s in range(0, n, _ROWS):
            d2 = x[s : s + _ROWS] @ y
            if j == i:
                last = np.tile(np.concatenate([[-1], gap[begin : end - 1]]), (len(d2), 1))
                last[np.arange(n)[None] <= np.arange(s, s + len(d2))[:, None]] = -1
                last = np.maximum.accumulate(last, axis=1)
                hit = ~(d2 > w[last] ** 2 + slack) & (last >= 0)
            else:
                hit = ~(d2 > np.maximum(limit[s : s + _ROWS, None], into_limit[None]))
            r, c = np.divmod(np.flatnonzero(hit), len(other))
            if not len(r):
                continue
            e = last[r, c] if j == i else np.maximum(from_[s + r], into[c])
            r += s
            p, q = order[begin + r], order[start + c]
            weight = np.maximum(_distances(own, other, r, c), np.maximum(core[p], core[q]))
            p, q = np.minimum(p, q), np.maximum(p, q)
            reached = many[q] & (weight == core[q])
            np.minimum.at(low, q[reached], p[reached])
            less = (weight < w[e]) | ((weight == w[e]) & ((p < a[e]) | ((p == a[e]) & (q < b[e]))))
            held.append((weight[less], p[less], q[less]))
            if sum(len(h[0]) for h in held) > _LINKS:
                held = [forest(len(order), *(np.concatenate(h) for h in zip(*held)))[:3]]
        between = max(between, int(gap[start : start + len(other)].max())) if j > i else between
    held = [np.concatenate(h) for h in zip(*held)] if held else [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    held = forest(len(order), *held)[:3] if len(held[0]) > len(order) else held
    return {"block": i, "points": len(held[0]), **dict(zip("wab", held)), "copied": np.flatnonzero(low < np.arange(len(low))), "first": low[low < np.arange(len(low))]}


def _labels(batches: Iterator[pa.RecordBatch], rows: str, state: str | None, found: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """(id, label) of every row: the tree of all rows, cut."""
    for _ in batches:
        pass
    ids, nulls, point, rank = _read(rows, "ids", "nulls", "owners", "first")
    ids, nulls, point, rank = _ints(ids), np.frombuffer(nulls, bool), _ints(point), _ints(rank)
    labels, total = np.full(len(ids), -1, np.int32), int((point >= 0).sum())
    if state and total >= max(2, k):
        core, w, a, b = (kind(x) for kind, x in zip((_floats, _floats, _ints, _ints), _read(state, "core", "w", "a", "b")))
        to, edges = np.arange(len(core)), [(w, a, b)]
        for uri in found:
            w, a, b, copied, low = (kind(x) for kind, x in zip((_floats, _ints, _ints, _ints, _ints), _read(uri, "w", "a", "b", "copied", "first")))
            edges.append((w, a, b))
            np.minimum.at(to, copied, low)
        w, a, b, _ = forest(len(core), *(np.concatenate(x) for x in zip(*edges)))
        copy = np.flatnonzero(rank[point[:total]] != np.arange(total))
        own = point[copy]
        w, a, b = np.concatenate([w, core[own]]), np.concatenate([rank[a], rank[to[own]]]), np.concatenate([rank[b], copy])
        by = np.lexsort((b, a, w))
        labels[:total] = tree_labels(total, zip(w[by].tolist(), a[by].tolist(), b[by].tolist()), k)
    for s in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + (1 << 16)], mask=nulls[s : s + (1 << 16)]), pa.array(labels[s : s + (1 << 16)])], ["id", "label"])


def density(rows: DataFrame, min_cluster_size: int, block_rows: int) -> DataFrame:
    """(id, label) of the rows (id, v), v not null."""
    spark = rows.sparkSession
    dtype = "float32" if rows.schema["v"].dataType.elementType.typeName() == "float" else "float64"
    total = rows.count()
    if not total:
        return rows.select("id", F.lit(-1).alias("label"))
    size = max(2, min(block_rows, max(_LEAST, -(-total // (2 * spark.sparkContext.defaultParallelism)))))
    paths, links = [], "w binary, a binary, b binary"

    def write(df: DataFrame, label: str) -> list:
        path, found = _write(df, label)
        paths.append(path)
        return found

    def each(tasks: int, label: str, schema: str, work: Callable[..., dict], **given) -> list:
        return write(_each(spark, tasks, partial(work, **given), f"block int, points int, {schema}"), label)

    packed = "block int, points int, width int, rows int, v binary, digests binary, ids binary, nulls binary, owners binary"
    raw = write(rows.coalesce(max(1, -(-total // size))).mapInArrow(partial(_pack, dtype=dtype, size=size), packed), "packed")
    if spark.read.schema("width int").parquet(paths[0]).distinct().limit(2).count() > 1:
        raise ValueError("vectors of different lengths")
    raw = [(r["uri"], r["points"]) for r in raw]
    known = each(1, "rows", "source binary, counts binary, first binary, ids binary, nulls binary, owners binary", _distinct, files=raw)[0]
    n, known, state, found = known["points"], known["uri"], None, []
    if n and total >= max(2, min_cluster_size):
        size, wide = max(2, min(size, n)), min(n, max(10, min_cluster_size + 2))
        blocks = -(-n // size)
        files = [(r["uri"], r["points"]) for r in each(blocks, "points", "v binary", _gather, files=raw, dtype=dtype, state=known, column="source", size=size)]
        delete(spark, paths[0])
        strips = [r["uri"] for r in each(blocks, "nearest", "core binary, near binary, which binary", _nearest, files=files, dtype=dtype, rows=known, k=min_cluster_size, wide=wide)]
        tree = f"core binary, part binary, {links}, order binary, gap binary"
        state = each(1, "tree", tree, _linked, files=files, strips=strips, wide=wide)[0]
        delete(spark, paths[-2])
        while state["points"] > 1:
            least = [r["uri"] for r in each(blocks, "links", links, _least, files=files, dtype=dtype, state=state["uri"])]
            state = each(1, "tree", tree, _joined, state=state["uri"], found=least)[0]
            for path in paths[-3:-1]:
                delete(spark, path)
        state = state["uri"]
        if n > 1:
            leaves = [(r["uri"], r["points"]) for r in each(blocks, "leaves", "v binary", _gather, files=files, dtype=dtype, state=state, column="order", size=size)]
            delete(spark, files[0][0].rsplit("/", 1)[0])
            found = [r["uri"] for r in each(blocks, "better", f"{links}, copied binary, first binary", _better, files=leaves, dtype=dtype, rows=known, state=state, size=size)]
    path = fresh_path(spark, "labels")
    spark.range(0, 1, 1, 1).mapInArrow(partial(_labels, rows=known, state=state, found=found, k=min_cluster_size), "id long, label int").write.parquet(path)
    for old in paths:
        delete(spark, old)
    return spark.read.schema("id long, label int").parquet(path)
