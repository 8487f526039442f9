"""Queries of rooms, ceilings and walls; their SQL states what each kind of page must give."""

from __future__ import annotations

from ..operators import plan_rooms as r
from .registry import add

_NO = "CAST(100 + CAST(substr(regexp_extract(text, '[0-9]{3}'), 1, 3) AS INT) - 100 AS VARCHAR)"
_AREA = "CASE WHEN label LIKE 'ACT%' THEN CAST(replace(regexp_extract(label, '- ([0-9,]+) SF', 1), ',', '') AS DOUBLE) ELSE area_sf END"
_TAG = "split_part(label, ' ', 1)"
_ROOMS = f"""
    SELECT plan_id, page_no, CASE plan_id % 6 WHEN 0 THEN 'CONFERENCE ROOM' WHEN 1 THEN 'MECHANICAL' WHEN 2 THEN 'LAB' WHEN 3 THEN 'AGAIN' ELSE 'LOBBY' END AS room, CASE WHEN plan_id % 6 < 4 THEN {_NO} END AS number,
      CASE plan_id % 6 WHEN 0 THEN '9''-6"' WHEN 1 THEN '12''-0"' WHEN 4 THEN '9''-0"' END AS ceiling_height, CASE plan_id % 6 WHEN 0 THEN 'ACT' WHEN 1 THEN 'Exposed Structure' WHEN 4 THEN 'GWB' END AS ceiling,
      CASE WHEN plan_id % 6 = 0 THEN 'ACT-1' END AS tag, CAST(NULL AS DOUBLE) AS area_sf, CASE plan_id % 6 WHEN 2 THEN 2 WHEN 4 THEN 4 ELSE 1 END AS found FROM room_pages WHERE plan_id % 6 < 5
    UNION ALL SELECT plan_id, page_no, label, NULL, NULL, NULL, {_TAG}, {_AREA}, 5 FROM room_marks WHERE label <> 'a cloud'"""
add("x9_rooms", ["room_pages", "room_marks"], r.rooms, f"SELECT * FROM ({_ROOMS})")
_TEXT_CEILINGS = """
    SELECT plan_id, page_no, CASE plan_id % 6 WHEN 0 THEN 'ACT' WHEN 1 THEN 'Exposed Structure' WHEN 2 THEN 'ACT' WHEN 3 THEN 'ACT' ELSE 'GWB' END AS ceiling, CASE WHEN plan_id % 6 IN (0, 2) THEN '2x4' END AS grid,
      CASE plan_id % 6 WHEN 0 THEN '9''-6"' WHEN 1 THEN '12''-0"' WHEN 4 THEN '9''-0"' END AS ceiling_height, CASE plan_id % 6 WHEN 1 THEN '12 FT' WHEN 2 THEN 'ARMSTRONG DUNE' END AS product,
      CASE plan_id % 6 WHEN 0 THEN 'ACT-1' WHEN 3 THEN 'ACT-2' END AS tag, CAST(NULL AS DOUBLE) AS area_sf FROM room_pages WHERE plan_id % 6 < 5
    UNION ALL SELECT plan_id, page_no, 'FW', NULL, NULL, '- 450 SF', NULL, NULL FROM room_pages WHERE plan_id % 7 = 0"""
_CEILINGS = f"""
    SELECT * FROM ({_TEXT_CEILINGS}) UNION ALL SELECT m.plan_id, m.page_no, 'ACT', NULL, NULL, NULL, m.tag, m.area_sf FROM
    (SELECT plan_id, page_no, {_TAG} AS tag, first({_AREA} ORDER BY mark_id) AS area_sf FROM room_marks WHERE label <> 'a cloud' GROUP BY 1, 2, 3) m
    WHERE NOT EXISTS (SELECT 1 FROM ({_TEXT_CEILINGS}) t WHERE t.plan_id = m.plan_id AND t.tag = m.tag)"""
add("x10_ceilings", ["room_pages", "room_marks"], r.ceilings, f"SELECT * FROM ({_CEILINGS})")
_COUNT = "CAST(regexp_extract(text, '([0-9]+) PANELS', 1) AS DOUBLE)"
add(
    "x11_walls", ["room_pages"], r.walls,
    f"SELECT plan_id, page_no, CASE WHEN plan_id % 7 IN (0, 4) THEN 'FW' ELSE 'AWP' END AS kind, CASE plan_id % 7 WHEN 1 THEN 'AWP-1' WHEN 4 THEN 'FW-2' END AS tag, CASE plan_id % 7 WHEN 0 THEN 450 WHEN 1 THEN CAST(replace(regexp_extract(text, 'AWP-1 - ([0-9,]+) SF', 1), ',', '') AS DOUBLE) WHEN 4 THEN {_COUNT} * 32 END AS area_sf, CASE plan_id % 7 WHEN 2 THEN CAST(regexp_extract(text, 'WAINSCOT - ([0-9]+) LF', 1) AS DOUBLE) END AS length_lf, CAST(CASE plan_id % 7 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 8 END AS DOUBLE) AS height_ft, CAST(CASE WHEN plan_id % 7 = 4 THEN 4 END AS DOUBLE) AS width_ft, CASE plan_id % 7 WHEN 1 THEN 'MAHARAM' END AS product, CAST(NULL AS STRING) AS location FROM room_pages WHERE plan_id % 7 < 5",
)
add(
    "x13_room_scopes", ["room_pages", "room_marks"], lambda p, m: r.suggested(r.rooms(p, m), r.ceilings(p, m)),
    f"""SELECT plan_id, CASE WHEN ceiling = 'Exposed Structure' OR ceiling = 'GWB' THEN NULL ELSE ceiling END AS scope_type, tag, area_sf, product, CAST(0.85 AS DOUBLE) AS confidence, 'ceiling' AS source, NULL AS room FROM ({_CEILINGS}) WHERE ceiling IN ('ACT', 'FW')
    UNION ALL SELECT plan_id, split_part(tag, '-', 1), tag, area_sf, NULL, CAST(0.75 AS DOUBLE), 'room', room FROM ({_ROOMS}) WHERE tag IS NOT NULL""",
)
