"""Paragraphs from lines of a page segment, as a decision table over the line before and the open paragraph."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

TERMINATORS = "。！：:？"
BRACKETS = {"《": "》", "（": "）", "(": ")"}
_HAN = re.compile("[一-鿿]")


@dataclass(frozen=True)
class Line:
    text: str
    x0: float
    x1: float
    top: float
    bottom: float
    size: float
    title: bool


def _open(text: str) -> bool:
    return any(text.count(a) > text.count(b) for a, b in BRACKETS.items())


def paragraphs(lines: list[Line], page_width: float, min_size: float = 0.0) -> list[str]:
    """Texts of the paragraphs of a segment, in order."""
    if not lines:
        return []
    left, right = min(x.x0 for x in lines), max(x.x1 for x in lines)
    starts_left, ends_right = left + 0.05 * (right - left), max(right - 0.05 * (right - left), 0.8 * page_width)
    out: list[str] = []
    para, title = "", ""

    def flush() -> None:
        nonlocal para
        if para:
            out.append(para)
        para = ""

    for i, line in enumerate(lines):
        before = lines[i - 1] if i else None
        gap = line.top - before.bottom if before else 0.0
        tall = line.bottom - line.top
        if line.title and i < len(lines) - 1:
            if title:
                if gap < tall + 0.5 * min_size:
                    title += line.text
                    continue
                flush()
                out.append(title)
                title = ""
            elif not before or gap > 1.2 * tall:
                title = line.text
                continue
        elif title:
            flush()
            out.append(title)
            title = ""
        resized = before is not None and line.size != before.size
        half = before is not None and before.x1 <= 0.5 * page_width
        short = before is not None and before.x1 <= ends_right
        if line.text[-1:] in TERMINATORS and line.text:
            if para and (resized or half or short):
                flush()
            para += line.text
            if not _open(line.text):
                flush()
            continue
        if para:
            lead = _HAN.search(line.text)
            unit = (line.x1 - line.x0) / max(1, len(line.text))
            lead_width = unit * (lead.start() if lead else len(line.text))
            if _open(para):
                pass
            elif line.x0 <= starts_left and re.match(r"[A-Za-z]{9}|\d{8}", line.text):
                pass
            elif resized or half:
                flush()
            elif lead_width > right - before.x1 and line.text[:1] not in "(（":
                pass
            elif short or para[-1] in ";；":
                flush()
        para += line.text
    flush()
    if title:
        out.append(title)
    return out


def assemble(lines: DataFrame, keys: list[str], page_width: float) -> DataFrame:
    """(keys, para_no, text) from lines (keys, line_no, text, x0, x1, top, bottom, size, is_title); keys bound a page segment."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [Line(r.text or "", r.x0, r.x1, r.top, r.bottom, r.size, bool(r.is_title)) for r in pdf.sort_values("line_no").itertuples(index=False)]
        smallest = min((r.size for r in rows), default=0.0)
        return pd.DataFrame([(*key, i, t) for i, t in enumerate(paragraphs(rows, page_width, smallest))], columns=[*keys, "para_no", "text"])

    types = dict(lines.dtypes)
    return lines.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", para_no int, text string")
