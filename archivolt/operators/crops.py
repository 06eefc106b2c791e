"""Search for the window of a picture that shows a reference: windows of many pairs, sizes, places and rotations scored in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the search.
LEAST_SCALE, SCALES, STEPS = 0.55, 10, 20
HIGH, MEDIUM, EQUAL = 20.0, 200.0, 0.01
#: Values that a block of windows holds, pairs of a block, and windows of a pair and rotation that are refined.
BLOCK, PAIRS, REFINED = 1 << 22, 64, 3


def crop_sizes(width: int, height: int, aspect: float) -> list[tuple[int, int]]:
    """The largest window of that aspect, and smaller ones down to 0.55 of it."""
    if width / height > aspect:
        w, h = round(height * aspect), height
    else:
        w, h = width, round(width / aspect)
    out = []
    for k in range(SCALES):
        scale = 1 - k * (1 - LEAST_SCALE) / (SCALES - 1)
        x = max(1, round(w * scale))
        size = (x, max(1, round(x / aspect)))
        if size[0] <= width and size[1] <= height and size not in out:
            out.append(size)
    return out


def _places(limit: int, size: int) -> np.ndarray:
    """Every twentieth of the window, and the last place."""
    return np.unique(np.append(np.arange(0, limit - size + 1, max(1, size // STEPS)), limit - size))


class Block:
    """References and candidates of some pairs, and the scores of windows of any of them."""

    def __init__(self, references: list[np.ndarray], candidates: list[np.ndarray], n: int, rotations: tuple[float, ...]):
        self.n, self.rotations = n, rotations
        self.width, self.height = (np.array([c.shape[k] for c in candidates]) for k in (1, 0))
        self.aspect = np.array([r.shape[1] / r.shape[0] for r in references])
        sizes = self.width * self.height
        self.offset = np.cumsum(sizes) - sizes
        self.pixels = np.concatenate([c.ravel() for c in candidates]).astype(np.int32)
        at = [np.rint(np.arange(n) * (s - 1) / (n - 1)).astype(int) for s in range(max(max(r.shape) for r in references) + 1)]
        self.wanted = np.stack([r[np.ix_(at[r.shape[0]], at[r.shape[1]])] for r in references]).astype(np.int32)

    def windows(self) -> np.ndarray:
        """Rows (pair, rotation, x, y, width, height) of the first look."""
        out = []
        for p, (w, h, aspect) in enumerate(zip(self.width.tolist(), self.height.tolist(), self.aspect.tolist(), strict=True)):
            for cw, ch in crop_sizes(w, h, aspect):
                y, x = (g.ravel() for g in np.meshgrid(_places(h, ch), _places(w, cw), indexing="ij"))
                for r in range(len(self.rotations)):
                    out.append(np.stack([np.full(len(x), v) if np.isscalar(v) else v for v in (p, r, x, y, cw, ch)], axis=1))
        return np.concatenate(out)

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """Mean squared difference of n x n samples; outside of the picture it is black."""
        step = max(1, BLOCK // (self.n * self.n))
        return np.concatenate([self._scores(windows[i : i + step]) for i in range(0, len(windows), step)]) if len(windows) else np.zeros(0)

    def _scores(self, windows: np.ndarray) -> np.ndarray:
        p, r, x, y, w, h = windows.T
        share = np.arange(self.n) / max(1, self.n - 1)
        across, down = share * (w - 1)[:, None], share * (h - 1)[:, None]
        angle = -np.radians(np.array(self.rotations))[r]
        turned = angle != 0
        sx = np.broadcast_to((x[:, None] + np.rint(across))[:, None, :], (len(p), self.n, self.n)).copy()
        sy = np.broadcast_to((y[:, None] + np.rint(down))[:, :, None], (len(p), self.n, self.n)).copy()
        if turned.any():
            t = np.flatnonzero(turned)
            cx, cy = (self.width[p[t]] / 2)[:, None, None], (self.height[p[t]] / 2)[:, None, None]
            dx, dy = (x[t, None] + across[t])[:, None, :] - cx, (y[t, None] + down[t])[:, :, None] - cy
            cos, sin = np.cos(angle[t])[:, None, None], np.sin(angle[t])[:, None, None]
            sx[t], sy[t] = np.rint(cx + dx * cos - dy * sin), np.rint(cy + dx * sin + dy * cos)
        inside = (sx >= 0) & (sy >= 0) & (sx < self.width[p][:, None, None]) & (sy < self.height[p][:, None, None])
        where = self.offset[p][:, None, None] + sy * self.width[p][:, None, None] + sx
        values = np.where(inside, self.pixels[np.where(inside, where, 0).astype(np.int64)], 0)
        return ((self.wanted[p] - values).astype(np.float64) ** 2).mean(axis=(1, 2))

    def refine(self, windows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows moved and resized in rounds of ever smaller steps, as long as any of them gets better."""
        windows, scores = windows.copy(), scores.copy()
        radius = np.maximum(1, np.maximum(windows[:, 4], windows[:, 5]) // STEPS)
        growth = np.maximum(1, np.rint(np.maximum(windows[:, 4], windows[:, 5]) * 0.03)).astype(int)
        moves = np.array([(dx, dy, dw) for dw in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        for divisor in (1, 2, 4, 8, None):
            step = np.ones(len(windows), dtype=int) if divisor is None else np.maximum(1, radius // divisor)
            grow = np.ones(len(windows), dtype=int) if divisor is None else np.maximum(1, growth // divisor)
            open_ = np.arange(len(windows))
            while len(open_):
                now = windows[open_]
                p = now[:, 0]
                w = np.clip(now[:, 4, None] + moves[:, 2] * grow[open_, None], 1, self.width[p, None])
                h = np.maximum(1, np.rint(w / self.aspect[p, None])).astype(int)
                x = np.clip(now[:, 2, None] + moves[:, 0] * step[open_, None], 0, self.width[p, None] - w)
                y = np.clip(now[:, 3, None] + moves[:, 1] * step[open_, None], 0, np.maximum(0, self.height[p, None] - h))
                tried = np.stack([np.broadcast_to(v, w.shape) for v in (p[:, None], now[:, 1, None], x, y, w, h)], axis=2)
                found = np.where(h <= self.height[p, None], self.scores(tried.reshape(-1, 6)).reshape(w.shape), np.inf)
                best = found.argmin(axis=1)
                value = found[np.arange(len(best)), best]
                better = value < scores[open_]
                windows[open_[better]], scores[open_[better]] = tried[np.arange(len(best)), best][better], value[better]
                open_ = open_[better]
        return windows, scores


def _best(windows: np.ndarray, scores: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k windows of each group by score, then in their own order."""
    order = np.lexsort((np.arange(len(scores)), scores, group))
    own = group[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    return order[place < k]


def found_crops(pairs: DataFrame, n: int = 24, rotations: tuple[float, ...] = (0.0,), refine: bool = True) -> DataFrame:
    """Adds score, x, y, width, height, rotation: the best window of each candidate for its reference.

    ``pairs`` has reference and candidate, structs (width, height, gray) with the gray values row by row. A first look
    scores windows of ten sizes at every twentieth of their length for each rotation; the best few of each rotation are
    then moved and resized in rounds. Windows of all pairs of a batch are rows of one block. Equal scores go to the first
    rotation, the larger window, then from the top left. Null where a picture is missing or its size and values disagree.
    """
    names = pairs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields), "score double, x int, y int, width int, height int, rotation double"])

    def picture(value: dict | None) -> np.ndarray | None:
        if value is None or value["gray"] is None or not (value["width"] or 0) > 0 or not (value["height"] or 0) > 0:
            return None
        if len(value["gray"]) != value["width"] * value["height"] or None in value["gray"]:
            return None
        return np.asarray(value["gray"], dtype=np.int32).reshape(value["height"], value["width"])

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        pictures = [[picture(v) for v in batch.column(names.index(c)).to_pylist()] for c in ("reference", "candidate")]
        good = [i for i, (a, b) in enumerate(zip(*pictures, strict=True)) if a is not None and b is not None]
        out = np.full((batch.num_rows, 6), np.nan)
        if good:
            held = Block([pictures[0][i] for i in good], [pictures[1][i] for i in good], n, rotations)
            windows = held.windows()
            scores = held.scores(windows)
            if refine:
                kept = _best(windows, scores, windows[:, 0] * len(rotations) + windows[:, 1], REFINED)
                windows, scores = held.refine(windows[kept], scores[kept])
            first = _best(windows, scores, windows[:, 0], 1)
            for i, at in zip(np.array(good)[windows[first, 0]].tolist(), first.tolist(), strict=True):
                _, r, x, y, w, h = windows[at].tolist()
                out[i] = scores[at], x, y, w, h, rotations[r]
        mask = np.isnan(out[:, 0])
        columns = [pa.array(out[:, 0], mask=mask), *(pa.array(np.where(mask, 0, out[:, k]).astype(np.int32), mask=mask) for k in range(1, 5)), pa.array(out[:, 5], mask=mask)]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, "score", "x", "y", "width", "height", "rotation"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PAIRS):
                yield block(whole.slice(start, PAIRS))

    return pairs.mapInArrow(run, schema)


def confidence(score: Column) -> Column:
    return F.when(score <= HIGH, "high").when(score <= MEDIUM, "medium").when(score.isNotNull(), "low")


def equal_export(score: Column, same_size: Column, decided: Column) -> Column:
    """Whether a candidate shows nothing but the export itself and nobody has decided on it yet, so that it is hidden."""
    return F.coalesce((score <= EQUAL) & same_size & ~decided, F.lit(False))
