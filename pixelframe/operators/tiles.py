"""Work on planes tile by tile, in Arrow: a tile is a square of cells with as many around it as its result depends on.

Rows are dealt and sorted by tile, and a task holds no more than a few small tiles or one large one at a time, whatever the image's size. Tiles
of one shape are worked on together. Cells near an edge are sent to the neighbouring tiles too; nothing is joined.

Several steps may follow one deal: deal with what they reach in all, put the columns through filters of lines (through) with any projections
between them, and leave out at the end (trim) what was only sent to be read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tiled = Callable[[np.ndarray, int, np.ndarray], np.ndarray]
#: Of the values of lines that lie one after the other, and the lines' lengths.
Lined = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Places of cells in one number: the row times this, and the column; doubles hold 2**26 of each exactly.
WIDE = 1 << 26
#: Cells along the edge of a tile, at least; and how many times its reach, so that few cells are sent twice.
EDGE, TIMES_REACH = 256, 3
#: Rows that a task gathers before it works on the tiles that are whole, and cells of tiles of one shape that it works on together.
ROWS, TOGETHER = 16_384, 1 << 20


def _nullable(table: pa.Table) -> pa.Table:
    """The table with nullable fields throughout, also inside structs, as Spark's schemas in text have them."""

    def kind(t: pa.DataType) -> pa.DataType:
        return pa.struct([pa.field(f.name, kind(f.type)) for f in t]) if pa.types.is_struct(t) else t

    return table.cast(pa.schema([pa.field(f.name, kind(f.type)) for f in table.schema]))


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of rows with equal keys begin."""
    todo, changed = [table.column(c).combine_chunks() for c in keys], np.zeros(max(0, len(table) - 1), bool)
    while todo:
        a = todo.pop()
        if pa.types.is_struct(a.type):
            todo += a.flatten()
            continue
        one, two = a[:-1], a[1:]
        changed |= pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False)
        changed |= pc.not_equal(pc.is_null(one), pc.is_null(two)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, changed])


def _edge(reach: int) -> int:
    return max(EDGE, TIMES_REACH * reach)


def deal(cells: DataFrame, reach: int, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Rows (by, y, x, and any columns) dealt and sorted by tile (_ty, _tx), each tile with reach cells around it.

    Tile (0, 0) begins reach cells before (0, 0): what lies before a plane's first cell is no tile of its own to which cells are sent.
    """
    edge, keys = _edge(reach), [*by, "_ty", "_tx"]

    def sent(c: str):
        low, high = F.floor(F.col(c) / edge), F.floor((F.col(c) + 2 * reach) / edge)
        return F.sequence(low, high) if reach else F.array(low)

    dealt = cells.select("*", F.explode(sent("y")).alias("_ty")).select("*", F.explode(sent("x")).alias("_tx"))
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def trim(dealt: DataFrame, reach: int) -> DataFrame:
    """Dealt rows without what was sent for reading only: each cell once, in its own tile."""
    own = lambda c, tile: F.floor((F.col(c) + reach) / _edge(reach)) == F.col(tile)
    return dealt.where(own("y", "_ty") & own("x", "_tx")).drop("_ty", "_tx")


def _tile_by_tile(dealt: DataFrame, keys: list[str], done: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """done of each run of whole tiles, which get the rows and where the tiles begin."""
    rows = ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, wanted = [], 0, rows
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= wanted:
                table = pa.Table.from_batches(held)
                starts = _starts(table, keys)
                yield from done(table.slice(0, starts[-1]), starts[:-1]) if len(starts) > 1 else ()
                held, n = table.slice(starts[-1]).to_batches(), n - int(starts[-1])
                wanted = max(rows, 2 * n)
        if n:
            table = pa.Table.from_batches(held)
            yield from done(table, _starts(table, keys))

    return dealt.mapInArrow(run, schema)


def through(dealt: DataFrame, made: dict[str, tuple[str, Lined | None, Lined | None]], by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """dealt rows, still dealt, with the columns of made {name: (column, along x, along y)}: the column's lines along x put through the one
    function, and then those along y through the other. None leaves them as they are.

    A line is what a tile holds of it, so results near the end of what was sent for reading only aren't those of the whole plane: filters
    in a row need the sum of their reaches. What a null is part of is null.
    """
    keys = [*by, "_ty", "_tx"]

    def done(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        y, x = (table.column(c).to_numpy() for c in "yx")
        tile = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(y)]))
        axes = []
        for line, at in ((y, x), (x, y)):
            order = np.lexsort((at, line, tile))
            first = np.flatnonzero(np.r_[True, (np.diff(tile[order]) != 0) | (np.diff(line[order]) != 0)])
            axes.append((order, np.diff(np.r_[first, len(y)])))

        def filtered(v: np.ndarray, fs: tuple[Lined | None, ...]) -> np.ndarray:
            for (order, lengths), f in zip(axes, fs):
                if f is not None:
                    out = np.empty(len(v))
                    out[order] = f(v[order], lengths)
                    v = out
            return v

        new = {}
        for name, (column, *fs) in made.items():
            values = table.column(column)
            lost = np.isnan(filtered(np.where(values.is_null().to_numpy(), np.nan, 0.0), fs)) if values.null_count else None
            new[name] = pa.array(filtered(values.to_numpy().astype(float), fs), pa.float64(), mask=lost)
        rest = _nullable(table.select(kept))
        yield from pa.table([*rest.columns, *new.values()], names=[*kept, *new]).to_batches()

    kept = [c for c in dealt.columns if c not in made]
    kinds = dict(dealt.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{c}` double" for c in made])
    return _tile_by_tile(dealt, keys, done, schema)


def by_tile(cells: DataFrame, reach: int, f: Tiled, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """f of each tile of planes (by, y, x, v), as a plane of the same cells.

    f gets tiles of one shape, each with reach cells around it, as an array (tile, row, column) in which cells that aren't there are NaN (outside
    the plane, too), reach, and the place (y, x) of each tile's first cell; it gives the values of the tiles without what is around them.
    """
    edge, together = _edge(reach), TOGETHER
    sent = deal(cells.select(*by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v")), reach, by)
    keys = [*by, "_ty", "_tx"]

    def done(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The results of whole tiles, which begin at starts."""
        y, x, v = (table.column(c).to_numpy() for c in "yxv")
        tile = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(y)]))
        y0, x0 = (table.column(c).to_numpy() * edge - reach for c in ("_ty", "_tx"))
        inside = (y >= y0) & (y < y0 + edge) & (x >= x0) & (x < x0 + edge)
        # Arrays as large as what is there; nothing beyond reach of it is read.
        far = np.iinfo(np.int64).max
        top, left = (np.minimum.reduceat(np.where(inside, c, far), starts) for c in (y, x))
        last, right = (np.maximum.reduceat(np.where(inside, c, -far), starts) for c in (y, x))
        some = np.flatnonzero(top < far)
        if not len(some):
            return
        out = np.full(len(y), np.nan)
        shapes, shape = np.unique(np.stack([last[some] - top[some] + 1, right[some] - left[some] + 1], 1), axis=0, return_inverse=True)
        shape = shape.ravel()
        # Tiles of a shape in turn, of each so many that the array stays small; rows in the same order.
        order = np.argsort(shape, kind="stable")
        within = np.empty(len(some), np.int64)
        within[order] = np.arange(len(some)) - np.searchsorted(shape[order], shape[order])
        size = np.maximum(1, together // ((shapes[:, 0] + 2 * reach) * (shapes[:, 1] + 2 * reach)))
        part = within // size[shape]
        piece = np.full(len(starts), -1)
        _, piece[some] = np.unique(np.stack([shape, part], 1), axis=0, return_inverse=True)
        of = piece[tile]
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(piece.max(initial=-1) + 2))
        for low, high in zip(bounds[:-1], bounds[1:]):
            k = order[low:high]
            own, slot = np.unique(tile[k], return_inverse=True)
            height, width = int(last[own[0]] - top[own[0]]) + 1, int(right[own[0]] - left[own[0]]) + 1
            values = np.full((len(own), height + 2 * reach, width + 2 * reach), np.nan)
            row, column = y[k] - top[tile[k]] + reach, x[k] - left[tile[k]] + reach
            read = (row >= 0) & (row < values.shape[1]) & (column >= 0) & (column < values.shape[2])
            values[slot[read], row[read], column[read]] = v[k][read]
            found = f(values, reach, np.stack([top[own], left[own]], 1))
            there = inside[k]
            out[k[there]] = found[slot[there], row[there] - reach, column[there] - reach]
        kept = _nullable(table.filter(pa.array(inside)).select([*by, "y", "x"]))
        yield from kept.append_column("v", pa.array(out[inside], pa.float64())).to_batches()

    kinds = {n: t for n, t in sent.dtypes}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", y int, x int, v double"
    return _tile_by_tile(sent, keys, done, schema)


def convolved(weights: list[float]) -> Tiled:
    """A separable filter by weights, for by_tile; each line is mirrored at its own ends."""
    w = np.array(weights)

    def along(a: np.ndarray, reach: int) -> np.ndarray:
        """Each row filtered, of which the reach at both ends is only read."""
        there = ~np.isnan(a)
        n = a.shape[1]
        low, high = there.argmax(axis=1), n - there[:, ::-1].argmax(axis=1)
        out = np.full((len(a), n - 2 * reach), np.nan)
        some = there.any(axis=1)
        ends = np.where(some, low * (n + 1) + high, -1)
        for end in np.unique(ends[some]):  # rows of one extent together; of most planes, all rows
            rows = np.flatnonzero(ends == end)
            lo, hi = divmod(int(end), n + 1)
            line = np.pad(a[rows, lo:hi], ((0, 0), (lo, n - hi)), "symmetric")
            out[rows] = sum(w[k] * line[:, k : k + n - 2 * reach] for k in range(len(w)))
        out[~there[:, reach : n - reach]] = np.nan
        return out

    def lines(a: np.ndarray, reach: int) -> np.ndarray:
        return along(a.reshape(-1, a.shape[2]), reach).reshape(*a.shape[:2], -1)

    def both(a: np.ndarray, reach: int, _) -> np.ndarray:
        return lines(lines(a, reach).transpose(0, 2, 1), reach).transpose(0, 2, 1)

    return both


def _running(a: np.ndarray, width: int) -> np.ndarray:
    """The maximum of each width cells of a row in a row, in three passes whatever the width: from block starts, to block ends, and of both."""
    rows, n = a.shape
    blocks = -(-n // width)
    padded = np.full((rows, blocks * width), -np.inf)
    padded[:, :n] = a
    cut = padded.reshape(rows, blocks, width)
    ahead = np.maximum.accumulate(cut, axis=2).reshape(rows, -1)
    behind = np.maximum.accumulate(cut[:, :, ::-1], axis=2)[:, :, ::-1].reshape(rows, -1)
    return np.maximum(behind[:, : n - width + 1], ahead[:, width - 1 : n])


def highest(chords: dict[int, int]) -> Tiled:
    """The maximum over a shape given by chords (rows from its middle: half width), for by_tile; cells that aren't there don't count.

    One running maximum for each different chord; a row's result is the maximum of its neighbours' by their chords.
    """

    def f(a: np.ndarray, reach: int, _) -> np.ndarray:
        a = np.where(np.isnan(a), -np.inf, a)
        height, width = (n - 2 * reach for n in a.shape[1:])
        out = np.full((len(a), height, width), -np.inf)
        for half in sorted(set(chords.values())):
            part = a[:, :, reach - half : a.shape[2] - reach + half]
            wide = _running(part.reshape(-1, part.shape[2]), 2 * half + 1).reshape(*a.shape[:2], width)
            for dy in (d for d, h in chords.items() if h == half):
                np.maximum(out, wide[:, reach + dy : reach + dy + height], out=out)
        return out

    return f


def labelled(diagonal: bool) -> Tiled:
    """Components of the cells that are there, inside a tile, for by_tile without reach: the place of each one's first cell, row by row, as row * WIDE + column.

    Runs of cells in a row are the nodes of a union-find; the least run of a component is its root.
    """
    more = 1 if diagonal else 0

    def one(a: np.ndarray, origin: np.ndarray) -> np.ndarray:
        there = ~np.isnan(a)
        height, width = a.shape
        steps = np.diff(np.pad(there.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(steps == 1)
        last = np.nonzero(steps == -1)[1]  # exclusive
        up = list(range(len(row)))
        starts = np.searchsorted(row, np.arange(height + 1)).tolist()
        lows, highs = first.tolist(), last.tolist()

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for y in range(1, height):
            i, j = starts[y - 1], starts[y]
            while i < starts[y] and j < starts[y + 1]:
                if lows[i] < highs[j] + more and lows[j] < highs[i] + more:
                    p, q = root(i), root(j)
                    up[max(p, q)] = min(p, q)
                if highs[i] < highs[j]:
                    i += 1
                else:
                    j += 1
        roots = np.array([root(k) for k in range(len(up))], np.int64)
        label = (row[roots] + origin[0]) * WIDE + first[roots] + origin[1]
        out = np.full(height * width, np.nan)
        out[there.ravel()] = np.repeat(label, last - first)
        return out.reshape(height, width)

    def f(a: np.ndarray, reach: int, origins: np.ndarray) -> np.ndarray:
        return np.stack([one(*x) for x in zip(a, origins)])

    return f
