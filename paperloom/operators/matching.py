"""Matches that depend on their order, and shapes beyond boxes: folds over one image's or page's rows."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import by_group
from .metrics import tree_distance

# Fixed values of the detection protocol: least shares of the truth and of the detection, weight of a split or merged match, least pieces of one.
TRUTH_SHARE, FOUND_SHARE, PIECE_WEIGHT, PIECES = 0.7, 0.6, 0.8, 2


def match_shares(sigma: np.ndarray, tau: np.ndarray) -> tuple[float, float]:
    """(recall sum, precision sum) of truths (rows) and detections (columns) from shares of the truth (sigma) and of the detection (tau).

    First pairs that fit each other and nothing else, then truths that several detections cover, then
    detections that cover several truths; each truth and detection counts once.
    """
    n, m = sigma.shape
    used_t, used_d = np.zeros(n, bool), np.zeros(m, bool)
    recall = precision = 0.0
    for t in range(n):
        s, f = np.flatnonzero(sigma[t] > TRUTH_SHARE), np.flatnonzero(tau[t] > FOUND_SHARE)
        if len(s) == len(f) == 1 and (sigma[:, s] > TRUTH_SHARE).sum() == 1 and (tau[:, f] > FOUND_SHARE).sum() == 1:
            recall, precision = recall + 1, precision + 1
            used_t[t] = used_d[s[0]] = True
    for t in np.flatnonzero(~used_t):
        if (sigma[t] > 0).sum() < PIECES:
            continue
        own = np.flatnonzero((tau[t] >= FOUND_SHARE) & ~used_d)
        if len(own) == 1:
            gain = (1.0, 1.0) if sigma[t, own[0]] >= TRUTH_SHARE else None
        else:
            gain = (PIECE_WEIGHT, len(own) * PIECE_WEIGHT) if sigma[t, own].sum() >= TRUTH_SHARE else None
        if gain:
            recall, precision = recall + gain[0], precision + gain[1]
            used_t[t], used_d[own] = True, True
    for d in np.flatnonzero(~used_d):
        if (tau[:, d] > 0).sum() < PIECES:
            continue
        own = np.flatnonzero((sigma[:, d] >= TRUTH_SHARE) & ~used_t)
        if len(own) == 1:
            gain = (1.0, 1.0) if tau[own[0], d] >= FOUND_SHARE else None
        else:
            gain = (len(own) * PIECE_WEIGHT, PIECE_WEIGHT) if tau[own, d].sum() >= FOUND_SHARE else None
        if gain:
            recall, precision = recall + gain[0], precision + gain[1]
            used_d[d], used_t[own] = True, True
    return recall, precision


def _shares(truth: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intersections of boxes over the truth's and over the detection's area, to two places."""
    low, high = np.maximum(truth[:, None, :2], found[None, :, :2]), np.minimum(truth[:, None, 2:], found[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(axis=2)
    area = lambda b: np.maximum((b[:, 2:] - b[:, :2]).prod(axis=1), 1e-9)
    return np.round(both / area(truth)[:, None], 2), np.round(both / area(found)[None, :], 2)


def detection_matches(boxes: DataFrame, keys: list[str], is_truth: Column, id_col: str = "box_id") -> DataFrame:
    """(keys, n_truth, n_found, recall_sum, precision_sum) of each image under split and merged matches."""

    def fold(truth: np.ndarray, *sides: np.ndarray) -> list[np.ndarray]:
        b = np.stack(sides, axis=1)
        t, d = b[truth.astype(bool)], b[~truth.astype(bool)]
        sums = match_shares(*_shares(t, d)) if len(t) and len(d) else (0.0, 0.0)
        return [np.array([x]) for x in (len(t), len(d), *sums)]

    rows = boxes.withColumn("_truth", is_truth.cast("int"))
    return by_group(rows, keys, [id_col], ["_truth", "x0", "y0", "x1", "y1"], fold, "n_truth long, n_found long, recall_sum double, precision_sum double")


def clipped_polygon(shape: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part of a convex polygon within another one; corners in turn."""
    if _area(by) < 0:
        by = by[::-1]
    out = shape
    for a, b in zip(by, np.roll(by, -1, axis=0)):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for k in range(len(out)):
            p, q, sp, sq = out[k], out[(k + 1) % len(out)], side[k], side[(k + 1) % len(out)]
            if sp >= 0:
                kept.append(p)
            if sp * sq < 0:
                kept.append(p + (q - p) * (sp / (sp - sq)))
        out = np.array(kept).reshape(-1, 2)
    return out


def _area(shape: np.ndarray) -> float:
    """Signed area of a polygon."""
    x, y = shape[:, 0], shape[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2) if len(shape) > 2 else 0.0


def polygon_iou(a: np.ndarray, b: np.ndarray) -> float:
    """IoU of convex polygons; 0 without area."""
    both = abs(_area(clipped_polygon(a, b)))
    union = abs(_area(a)) + abs(_area(b)) - both
    return both / union if union > 0 else 0.0


def polygon_nms(shapes: DataFrame, keys: list[str], most: float, id_col: str = "box_id", score: str = "score", points: str = "points") -> DataFrame:
    """(keys, id, score): convex polygons (x, y in turn) by falling score, without those whose IoU with a kept one is above `most`."""

    def fold(ids: np.ndarray, scores: np.ndarray, flat: np.ndarray) -> list[np.ndarray]:
        own = [np.asarray(f, float).reshape(-1, 2) for f in flat]
        kept: list[int] = []
        for i in np.lexsort((ids, -scores)):
            if all(polygon_iou(own[i], own[k]) <= most for k in kept):
                kept.append(i)
        return [ids[kept], scores[kept]]

    types = dict(shapes.dtypes)
    return by_group(shapes, keys, [id_col], [id_col, score, points], fold, f"{id_col} {types[id_col]}, {score} double")


def merged_stacks(boxes: DataFrame, keys: list[str], id_col: str = "box_id", overlap: float = 0.8, depth: float = 10.0) -> DataFrame:
    """(keys, id, x0, y0, x1, y1): texts that lie over one another joined, in the order of their ids; an anchor grows as it takes in others."""

    def fold(ids: np.ndarray, *sides: np.ndarray) -> list[np.ndarray]:
        b = np.stack(sides, axis=1).astype(float)
        used = np.zeros(len(b), bool)
        for i in range(len(b)):
            for j in range(len(b)):
                if used[i] or used[j] or i == j:
                    continue
                wide = (min(b[i, 2], b[j, 2]) - max(b[i, 0], b[j, 0])) / max(1.0, min(b[i, 2] - b[i, 0], b[j, 2] - b[j, 0]))
                if wide >= overlap and min(b[i, 3], b[j, 3]) - max(b[i, 1], b[j, 1]) > depth:
                    b[i] = [*np.minimum(b[i, :2], b[j, :2]), *np.maximum(b[i, 2:], b[j, 2:])]
                    used[j] = True
        return [ids[~used], *b[~used].T]

    return by_group(boxes, keys, [id_col], [id_col, "x0", "y0", "x1", "y1"], fold, f"{id_col} {dict(boxes.dtypes)[id_col]}, x0 double, y0 double, x1 double, y1 double")


def roomier(boxes: DataFrame, keys: list[str], margin: float, page_width: float, page_height: float, grows: Column | None = None, id_col: str = "box_id", near: float = 8.0) -> DataFrame:
    """(keys, id, x0, y0, x1, y1): boxes that overlap no other one, moved out side by side by the margin where they still overlap none.

    A side that comes within `near` of the page's border goes to it. Boxes are taken in the order of
    their ids and see those before them as grown.
    """
    page = np.array([page_width - 1, page_height - 1])

    def fold(ids: np.ndarray, may: np.ndarray, *sides: np.ndarray) -> list[np.ndarray]:
        b = np.stack(sides, axis=1).astype(float)

        def free(i: int, new: np.ndarray) -> bool:
            both = np.minimum(b[:, 2:], new[2:]) - np.maximum(b[:, :2], new[:2])
            hit = (both > 0).all(axis=1)
            hit[i] = False
            return not hit.any()

        for i in np.flatnonzero(may):
            if not free(i, b[i]):
                continue
            for axis, size in ((0, page_width), (1, page_height)):
                low, high = b[i, axis] - margin, b[i, axis + 2] + margin
                for side, value in ((axis, 0.0 if low <= near else low), (axis + 2, size if high + near >= size else high)):
                    new = b[i].copy()
                    new[side] = value
                    new = np.clip(new, 0, np.concatenate([page, page]))
                    if free(i, new):
                        b[i] = new
        return [ids, *b.T]

    rows = boxes.withColumn("_grows", (F.lit(True) if grows is None else grows).cast("int"))
    return by_group(rows, keys, [id_col], [id_col, "_grows", "x0", "y0", "x1", "y1"], fold, f"{id_col} {dict(boxes.dtypes)[id_col]}, x0 double, y0 double, x1 double, y1 double")


def wider(boxes: DataFrame, keys: list[str], page_width: float, is_text: Column, id_col: str = "box_id", ratio: float = 0.2) -> DataFrame:
    """(keys, id, x0, y0, x1, y1): texts widened by a share of their height on both sides, unless they would reach into a neighbour from the side."""

    def fold(ids: np.ndarray, text: np.ndarray, *sides: np.ndarray) -> list[np.ndarray]:
        b = np.stack(sides, axis=1).astype(float)
        for i in np.flatnonzero(text):
            more = int(ratio * (b[i, 3] - b[i, 1]))
            x0, x1 = max(b[i, 0] - more, 0), min(b[i, 2] + more, page_width - 1)
            meets = (np.minimum(b[:, 2], x1) > np.maximum(b[:, 0], x0)) & (np.minimum(b[:, 3], b[i, 3]) > np.maximum(b[:, 1], b[i, 1]))
            beside = ((b[:, 0] < x0) & (x0 < b[:, 2]) & (b[:, 2] < x1)) | ((x0 < b[:, 0]) & (b[:, 0] < x1) & (x1 < b[:, 2]))
            beside[i] = False
            if not (meets & beside).any():
                b[i, 0], b[i, 2] = x0, x1
        return [ids, *b.T]

    rows = boxes.withColumn("_text", is_text.cast("int"))
    return by_group(rows, keys, [id_col], [id_col, "_text", "x0", "y0", "x1", "y1"], fold, f"{id_col} {dict(boxes.dtypes)[id_col]}, x0 double, y0 double, x1 double, y1 double")


def stacks(boxes: DataFrame, keys: list[str], id_col: str = "box_id", overlap: float = 0.3) -> DataFrame:
    """(keys, stack, place, id): boxes from top to bottom, each put under the first open stack whose lowest box is nearer than the box's height and shares more than `overlap` of either width."""

    def fold(ids: np.ndarray, *sides: np.ndarray) -> list[np.ndarray]:
        b = np.stack(sides, axis=1).astype(float)
        free = np.argsort(b[:, 1], kind="stable").tolist()
        rows, n = [], 0
        while free:
            stack = [free[0]]
            for i in free[1:]:
                last = b[stack[-1]]
                shared = min(b[i, 2], last[2]) - max(b[i, 0], last[0])
                if abs(b[i, 1] - last[3]) < b[i, 3] - b[i, 1] and max(shared / max(1e-9, b[i, 2] - b[i, 0]), shared / max(1e-9, last[2] - last[0])) > overlap:
                    stack.append(i)
            rows += [(n, k, i) for k, i in enumerate(stack)]
            free = [i for i in free if i not in set(stack)]
            n += 1
        stack_no, place, at = (np.array(x) for x in zip(*rows))
        return [stack_no.astype(np.int32), place.astype(np.int32), ids[at]]

    return by_group(boxes, keys, [id_col], [id_col, "x0", "y0", "x1", "y1"], fold, f"stack int, place int, {id_col} {dict(boxes.dtypes)[id_col]}")


def collated_lines(chars: DataFrame, keys: list[str], order: str = "char_no", same: float = 0.33, far: float = 3.0, space: float = 3.0, twin: float = 0.5) -> DataFrame:
    """(keys, line, x0, x1, text): characters from left to right in lines, each as a text.

    A line breaks where the height over the line's first character is above `same` of the size, or
    the gap above `far` of it; lines of blanks go. Blanks at the end and characters printed twice
    within `twin` go, gaps above `space` become blanks.
    """

    def fold(text: np.ndarray, x0: np.ndarray, x1: np.ndarray, top: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        lines, line = [], []
        for i in np.argsort(x0, kind="stable"):
            if line and (abs(top[i] - top[line[0]]) > same * size[i] or x0[i] - x1[line[-1]] > far * size[i]):
                lines.append(line)
                line = []
            line.append(i)
        out = []
        for own in [*lines, line]:
            if not any(text[i].strip() for i in own):
                continue
            while text[own[-1]][:1] == " ":
                own.pop()
            kept = own[:1]
            for i in own[1:]:
                if not (text[i] == text[kept[-1]] and x0[i] <= x0[kept[-1]] + twin):
                    kept.append(i)
            parts = [text[kept[0]]] + [(" " if x0[i] > x1[j] + space else "") + text[i] for j, i in zip(kept, kept[1:])]
            out.append((len(out), x0[kept[0]], x1[kept[-1]], "".join(parts)))
        columns = [np.array(x) for x in zip(*out)] if out else [np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0, str)]
        return [columns[0].astype(np.int32), columns[1].astype(float), columns[2].astype(float), columns[3].astype(object)]

    return by_group(chars, keys, [order], ["text", "x0", "x1", "top", "size"], fold, "line int, x0 double, x1 double, text string")


def columns_by_rule(upper: list[tuple[int, int]], lower: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Columns of two rows of as many cells, stretched so that they end alike: where one ends later, the other's borders from there on move."""
    a, b = [list(c) for c in sorted(upper)], [list(c) for c in sorted(lower)]
    for i in range(min(len(a), len(b))):
        off = b[i][1] - a[i][1]
        at = min(a[i][1], b[i][1])
        for cell in a if off > 0 else b if off < 0 else ():
            for k in range(2):
                cell[k] += abs(off) * (cell[k] >= at)
    return [tuple(c) for c in a], [tuple(c) for c in b]


def columns_by_place(upper: list[float], lower: list[float], tolerance: float = 6.0) -> tuple[list[int], list[int]]:
    """Places of two tables' column borders in their common grid; a lower border within the tolerance of an upper one is that one (the first)."""
    first = sorted(set(upper))
    second = sorted({next((u for u in first if abs(v - u) <= tolerance), v) for v in sorted(set(lower))})
    every = sorted({*first, *second})
    return [every.index(x) for x in first], [every.index(x) for x in second]


def paired_tables(rows: DataFrame, keys: list[str], upper: str, lower: str, tolerance: float = 6.0) -> DataFrame:
    """(keys, upper_at, lower_at): columns_by_place of each pair of tables from two arrays of borders."""

    @F.pandas_udf("upper_at array<int>, lower_at array<int>")
    def places(u: pd.Series, v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([columns_by_place(list(a), list(b), tolerance) for a, b in zip(u, v)], columns=["upper_at", "lower_at"])

    return rows.select(*keys, places(upper, lower).alias("_p")).select(*keys, "_p.upper_at", "_p.lower_at")


class _Tables(HTMLParser):
    """The first table of a page as nested (tag, rowspan, colspan, text) and children."""

    def __init__(self):
        super().__init__()
        self.root, self.open_, self.texts = ("table", []), [], []

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.open_ = [("tr", [])]
            self.root[1].append(self.open_[0])
        elif tag in ("td", "th") and self.open_:
            spans = dict(attrs)
            self.texts = []
            self.open_ = [self.open_[0], (("td", int(spans.get("rowspan") or 1), int(spans.get("colspan") or 1), self.texts), [])]
            self.open_[0][1].append(self.open_[1])

    def handle_endtag(self, tag):
        if tag in ("td", "th") and len(self.open_) > 1:
            self.open_ = self.open_[:1]

    def handle_data(self, data):
        if len(self.open_) > 1:
            self.texts.append(data)


#: Tables as to_html writes them; others are read by the parser.
_CELL = r'<td(?: rowspan="([0-9]+)")?(?: colspan="([0-9]+)")?>([^<&]*)</td>'
_PLAIN = re.compile(rf"<table>(?:<tr>(?:{_CELL})*</tr>)*</table>")
_CELLS, _ROWS = re.compile(_CELL), re.compile("<tr>(.*?)</tr>", re.S)


def table_tree(page: str | None) -> tuple:
    if page and _PLAIN.fullmatch(page):
        return "table", [("tr", [(("td", int(r or 1), int(c or 1), t), []) for r, c, t in _CELLS.findall(row)]) for row in _ROWS.findall(page)]
    reader = _Tables()
    reader.feed(page or "")

    def plain(node):
        label = node[0] if isinstance(node[0], str) else (*node[0][:3], "".join(node[0][3]))
        return label, [plain(c) for c in node[1]]

    return plain(reader.root)


def _aligned_cost(x: tuple, y: tuple, rename) -> float | None:
    """Cost of renaming every node of x to the one in its place in y; None if their shapes differ."""
    if len(x[1]) != len(y[1]):
        return None
    total = 0.0
    for a, b in zip(x[1], y[1]):
        cost = _aligned_cost(a, b, rename)
        if cost is None:
            return None
        total += cost
    return total + rename(x[0], y[0])


def table_similarity(a: str | None, b: str | None, structure_only: bool = False) -> float:
    """1 - tree edit distance of two HTML tables over the larger number of nodes; cells of equal spans cost the share of their text that differs.

    In trees of one shape any edit besides renaming in place deletes and inserts a node at least, at a
    cost of 2, so a cheaper renaming is the distance; only other trees are searched.
    """
    from .metrics import _similar

    if a == b:
        return 1.0
    x, y = table_tree(a), table_tree(b)
    size = lambda t: 1 + sum(map(size, t[1]))
    if not x[1] or not y[1]:
        return float(not x[1] and not y[1])
    costs: dict = {}

    def rename(p, q) -> float:
        if p == q:
            return 0.0
        if isinstance(p, str) or isinstance(q, str) or p[:3] != q[:3]:
            return 1.0
        if structure_only:
            return 0.0
        pair = p[3], q[3]
        if pair not in costs:
            costs[pair] = 1 - (_similar(*pair) if max(map(len, pair)) > 40 else 1 - _short_distance(*pair) / max(map(len, pair)))
        return costs[pair]

    cost = _aligned_cost(x, y, rename)
    if cost is None or cost > 2:
        cost = tree_distance(x, y, rename)
    return 1 - cost / max(size(x), size(y))


def _short_distance(a: str, b: str) -> int:
    """Edit distance of short texts, without their common start and end."""
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    i, j = len(a), len(b)
    while i > lo and j > lo and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    a, b = a[lo:i], b[lo:j]
    if not a or not b:
        return len(a) + len(b)
    if len(a) == 1 or len(b) == 1:
        return max(len(a), len(b)) - (a in b or b in a)
    row = list(range(len(b) + 1))
    for k, c in enumerate(a, 1):
        back, row[0] = row[0], k
        for m, d in enumerate(b, 1):
            back, row[m] = row[m], min(row[m] + 1, row[m - 1] + 1, back + (c != d))
    return row[-1]


def table_scores(pairs: DataFrame, pred: str, truth: str, structure_only: bool = False) -> DataFrame:
    """pairs with `similarity` of their two HTML tables; a row is compared by itself."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(table_similarity(x, y, structure_only), 6) for x, y in zip(a, b)], dtype=float)

    return pairs.withColumn("similarity", score(pred, truth))
