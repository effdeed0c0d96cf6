"""Detection models as plug-ins: one object for each task, batches of windows in, detections out."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame


class Model(Protocol):
    """What a model offers: boxes, scores and labels for each window of a batch, with its prompt boxes; ``close`` frees it."""

    def predict(self, windows: list[dict], text: str, prompts: list[list[list[float]]]) -> list[list[dict]]: ...

    def close(self) -> None: ...


class TableModel:
    """Stands in for a network: answers with the prompt boxes themselves, scored by a fixed rule."""

    def __init__(self, score: float = 0.9):
        self.score = score

    def predict(self, windows, text, prompts):
        return [[{"x1": b[0], "y1": b[1], "x2": b[2], "y2": b[3], "score": self.score, "label": 1} for b in boxes] for boxes in prompts]

    def close(self) -> None:
        pass


_MODELS: dict[str, Callable[[], Model]] = {"table": TableModel}


def register(name: str, make: Callable[[], Model]) -> None:
    _MODELS[name] = make


def model(name: str) -> Model:
    if name not in _MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(_MODELS))}")
    return _MODELS[name]()


def predicted(windows: DataFrame, name: str = "table", text: str = "", batch: int = 8) -> DataFrame:
    """windows(img, no, x, y, prompts array of boxes) -> (img, no, score, label, x1..y2, seg), moved from window to image pixels."""

    def run(frames):
        import pandas as pd

        net = model(name)
        try:
            for pdf in frames:
                rows = pdf.to_dict("records")
                for k in range(0, len(rows), batch):
                    part = rows[k : k + batch]
                    found = net.predict(part, text, [[list(b) for b in r["prompts"]] for r in part])
                    out = []
                    for r, dets in zip(part, found, strict=True):
                        for d in dets:
                            x1, y1, x2, y2 = d["x1"] + r["x"], d["y1"] + r["y"], d["x2"] + r["x"], d["y2"] + r["y"]
                            out.append((r["img"], r["no"], d["score"], d["label"], x1, y1, x2, y2, [[x1, y1, x2, y1, x2, y2, x1, y2]]))
                    yield pd.DataFrame(out, columns=["img", "no", "score", "label", "x1", "y1", "x2", "y2", "seg"])
        finally:
            net.close()

    return windows.select("img", "no", "x", "y", "prompts").mapInPandas(run, "img long, no long, score double, label int, x1 double, y1 double, x2 double, y2 double, seg array<array<double>>")


def mask_ring(mask, level: float = 0.5) -> list[float] | None:
    """Outline of the first region of a mask (rows from the top) as a flat ring of cell corners; None without cells."""
    import numpy as np

    m = np.asarray(mask) > level
    at = np.argwhere(m)
    if not len(at):
        return None
    region, todo = {tuple(at[0])}, [tuple(at[0])]
    while todo:
        r, c = todo.pop()
        for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and m[q] and q not in region:
                region.add(q)
                todo.append(q)
    side: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in region:  # directed sides with the region on the right
        for a, b, q in (((c, r), (c + 1, r), (r - 1, c)), ((c + 1, r), (c + 1, r + 1), (r, c + 1)), ((c + 1, r + 1), (c, r + 1), (r + 1, c)), ((c, r + 1), (c, r), (r, c - 1))):
            if q not in region:
                side.setdefault(a, []).append(b)
    start = min(side, key=lambda p: (p[1], p[0]))
    ring, p = [start], side[start].pop()
    while p != start:
        ring.append(p)
        p = side[p].pop()
    keep = [b for a, b, c in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1], strict=True) if (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0])]
    return [float(v) for p in keep for v in p]
