"""Schemas of the tables of primitives and of the nested document."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


CHARS = _struct("doc_id long, page_no int, char_id int, text string, x0 double, x1 double, top double, bottom double, doctop double, size double, fontname string, upright boolean, color double")
EDGES = _struct("doc_id long, page_no int, edge_id int, orientation string, x0 double, x1 double, top double, bottom double")
BOXES = _struct("image_id long, box_id long, label string, score double, x0 double, y0 double, x1 double, y1 double")
CELLS = _struct("table_id long, r0 int, c0 int, r1 int, c1 int, text string")
CONTEXT = _struct("doc_id long, idx int, type string, text string, pid int, sid int, cid string, page_idx int, text_box array<int>, is_title boolean")
DOCUMENT = _struct("doc_id long, metadata struct<headers: array<string>, footers: array<string>, catalogs: array<string>, pages_bbox: array<array<int>>>, chapters map<string, string>, context array<struct<idx: int, type: string, text: string, pid: int, sid: int, cid: string, page_idx: int, text_box: array<int>, is_title: boolean>>")
