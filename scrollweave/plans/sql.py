"""DuckDB SQL that gives the rows of the catalogued queries."""

from __future__ import annotations

from ..functions.text import TIME, WS
from .views import CLOCK, ENDS, NAMES, RATES


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def norm(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '[{WS}]+', ' ', 'g'))"


def count_words(e: str) -> str:
    return f"len(regexp_extract_all({e}, '[^{WS}]+'))"


def initials(e: str) -> str:
    return rf"(regexp_matches({strip(e)}, '^[\p{{Lu}}\p{{Lo}}\p{{Lm}}]{{2,3}}$') AND regexp_matches({strip(e)}, '\p{{Lu}}'))"


def speaker(e: str) -> str:
    s = strip(e)
    return rf"(length({s}) BETWEEN 2 AND 60 AND NOT regexp_matches({s}, '{TIME}') AND {count_words(e)} <= 6 AND NOT (regexp_matches({s}, '[.?!]$') AND {count_words(e)} > 1) AND NOT {initials(e)} AND (regexp_matches({s}, '^\p{{Lu}}') OR contains({s}, '@')))"


def clean(e: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({strip(e)}, '^[.,;:-]+|[.,;:-]+$', '', 'g'), '^\[.*?\][{WS}]*', '')")


def two(e: str) -> str:
    return f"lpad(({e})::BIGINT::VARCHAR, 2, '0')"


def clock(e: str) -> str:
    return f"({two(f'({e}) // 3600')} || ':' || {two(f'(({e}) % 3600) // 60')} || ':' || {two(f'({e}) % 60')})"


def seconds(e: str) -> str:
    return f"(split_part({e}, ':', 1)::BIGINT * 3600 + split_part({e}, ':', 2)::BIGINT * 60 + split_part({e}, ':', 3)::BIGINT)"


def listed(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in values) + "]"


def duration(e: str) -> str:
    s = f"floor({e})::BIGINT"
    return f"CASE WHEN {s} >= 3600 THEN ({s} // 3600) || 'h ' || (({s} % 3600) // 60) || 'm ' || ({s} % 60) || 's' WHEN {s} >= 60 THEN ({s} // 60) || 'm ' || ({s} % 60) || 's' ELSE {s} || 's' END"


_all = f"list_concat([{listed(NAMES)}[((conv_id + turn // 4) % 3 + 1)::INT], {clock('9 * 3600 + conv_id % 7 * 600 + turn * 25')}], string_split(text, chr(10)))"
LINES = f"lines AS (SELECT conv_id AS video_id, turn * 100000 + k - 1 AS line_no, line FROM (SELECT conv_id, turn, unnest({_all}) AS line, generate_subscripts({_all}, 1) AS k FROM conversations))"

ENTRIES = f"""{LINES},
l1 AS (SELECT video_id, line_no, {strip('line')} AS l FROM lines),
l2 AS (SELECT *, {initials('l')} AS mark, {speaker('l')} AS name, regexp_extract(l, '({TIME})', 1) AS t FROM l1),
l3 AS (SELECT *, l <> '' AND t <> '' AND NOT mark AS timed,
  CASE WHEN t <> '' THEN {strip("left(l, instr(l, t)::INT - 1)")} ELSE '' END AS head,
  CASE WHEN t <> '' THEN {strip("substr(l, instr(l, t) + length(t))")} ELSE '' END AS tail,
  CASE WHEN lag(l, 1) OVER w = '' OR lag(mark, 1) OVER w THEN CASE WHEN lag(name, 2) OVER w THEN lag(l, 2) OVER w END
       WHEN lag(name, 1) OVER w THEN lag(l, 1) OVER w END AS above
  FROM l2 WINDOW w AS (PARTITION BY video_id ORDER BY line_no)),
l4 AS (SELECT *, bool_or(timed) OVER (PARTITION BY video_id ORDER BY line_no) AND NOT timed AND l <> '' AND NOT mark AS plain FROM l3),
l5 AS (SELECT *, plain AND name AND length(l) < 60 AS names FROM l4),
l6 AS (SELECT video_id, line_no, timed OR names AS begins, CASE WHEN timed THEN t END AS t,
  {clean(f"CASE WHEN timed THEN CASE WHEN head = '' THEN above WHEN {speaker('head')} THEN head END WHEN names THEN l END")} AS said,
  CASE WHEN timed AND tail <> '' THEN tail WHEN plain AND NOT names THEN l END AS piece FROM l5),
l7 AS (SELECT video_id, line_no, piece, sum(begins::INT) OVER w AS grp, last_value(said IGNORE NULLS) OVER w AS speaker, last_value(t IGNORE NULLS) OVER w AS ts
  FROM l6 WINDOW w AS (PARTITION BY video_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l8 AS (SELECT video_id, grp, coalesce(any_value(speaker), '') AS speaker, any_value(ts) AS "timestamp", {strip("string_agg(piece, ' ' ORDER BY line_no)")} AS text FROM l7 WHERE piece IS NOT NULL GROUP BY video_id, grp),
entries AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY grp) AS entry_no, speaker, "timestamp", {seconds('"timestamp"')} AS timestamp_seconds, text, 0.0::DOUBLE AS confidence FROM l8)"""

MERGED = f"""{ENTRIES},
r1 AS (SELECT *, coalesce(speaker <> lag(speaker) OVER (PARTITION BY video_id ORDER BY entry_no), true)::INT AS turn FROM entries),
r2 AS (SELECT *, sum(turn) OVER (PARTITION BY video_id ORDER BY entry_no) AS run FROM r1),
fold AS (
  SELECT video_id, run, entry_no, timestamp_seconds AS anchor, entry_no AS head FROM r2 WHERE turn = 1
  UNION ALL
  SELECT r.video_id, r.run, r.entry_no,
    CASE WHEN abs(r.timestamp_seconds - f.anchor) < 60 THEN f.anchor ELSE r.timestamp_seconds END,
    CASE WHEN abs(r.timestamp_seconds - f.anchor) < 60 THEN f.head ELSE r.entry_no END
  FROM fold f JOIN r2 r ON r.video_id = f.video_id AND r.run = f.run AND r.entry_no = f.entry_no + 1),
m1 AS (SELECT f.video_id, f.head, any_value(e.speaker) AS speaker, string_agg(e.text, ' ' ORDER BY e.entry_no) AS text FROM fold f JOIN entries e USING (video_id, entry_no) GROUP BY f.video_id, f.head),
merged AS (SELECT m1.video_id, row_number() OVER (PARTITION BY m1.video_id ORDER BY head) AS entry_no, m1.speaker, e."timestamp", e.timestamp_seconds, m1.text, e.confidence FROM m1 JOIN entries e ON e.video_id = m1.video_id AND e.entry_no = m1.head)"""

STATS = f"""{MERGED},
s1 AS (SELECT video_id, count(DISTINCT CASE WHEN speaker <> '' THEN speaker END) AS speakers, count(*) AS messages, string_agg(text, ' ' ORDER BY entry_no) AS all_text FROM merged GROUP BY video_id),
stats AS (SELECT video_id, speakers, messages, {count_words('all_text')} AS word_count, len(list_distinct(list_transform(regexp_extract_all(all_text, '[^{WS}]+'), lambda x: lower(x)))) AS unique_words, length(all_text) AS character_count, 0.0::DOUBLE AS average_confidence FROM s1),
meta AS (SELECT conv_id AS video_id, 'meeting-' || conv_id || '.mp4' AS source_file, count(*) * 25.0::DOUBLE AS duration_seconds, count(*) * 2 AS frames_processed, count(*) AS frames_with_text, '{CLOCK}' AS extraction_timestamp, 'table' AS ocr_engine, 0.5::DOUBLE AS confidence_threshold FROM conversations GROUP BY conv_id),
raw AS (SELECT video_id, string_agg(line, chr(10) ORDER BY line_no) AS raw_text FROM lines GROUP BY video_id)"""

VIDEOS = f"""videos AS (SELECT o_orderkey AS video_id, '/in/v' || o_orderkey || {listed(ENDS)}[(o_orderkey % 7 + 1)::INT] AS path, o_orderkey % 11 <> 0 AS present,
  640 + (o_orderkey % 5) * 320 - (o_orderkey % 3) * 160 AS width, 480 + (o_orderkey % 4) * 120 - (o_orderkey % 3) * 60 AS height, {listed(RATES)}[(o_orderkey % 6 + 1)::INT] AS fps, (o_orderkey % 13) * 20 AS frame_count FROM orders),
checked AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ending FROM videos),
validated AS (SELECT *, CASE WHEN NOT present THEN 'Video file not found: ' || path WHEN ending NOT IN ('.mp4', '.mov', '.avi', '.mkv', '.webm', '.m4v') THEN 'Unsupported format: ' || regexp_extract(path, '(\\.[^./]*)$', 1)
  WHEN width < 640 OR height < 480 THEN 'Resolution too low: ' || width || 'x' || height || ' (minimum 640x480)' WHEN frame_count = 0 THEN 'Video has no frames' WHEN fps <= 0 THEN 'Could not determine video FPS' END AS error FROM checked),
sampled AS (SELECT video_id, unnest(range(0, frame_count, step)) AS frame_number, fps FROM (SELECT *, CASE WHEN 2.0 >= fps THEN 1 ELSE greatest(1, round_even(fps / 2.0, 0)::BIGINT) END AS step FROM validated WHERE error IS NULL)),
frames AS (SELECT video_id, frame_number, frame_number / fps AS timestamp_seconds FROM sampled)"""

REGIONS = f"""words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^{WS}]+')) AS text, generate_subscripts(regexp_extract_all(text, '[^{WS}]+'), 1) - 1 AS p FROM documents),
regions AS (SELECT doc_id AS video_id, p // 60 AS frame_number, p % 60 AS idx, text, ((p * 37) % 100) / 100 AS confidence, (p % 60 % 6) * 100 AS x, (p % 60 // 6) * 30 + (p % 60 * 7) % 13 AS y, length(text) * 10 AS w, 12 AS h FROM words)"""


def lines_of(where: str, breaks: str) -> str:
    """Regions with the number of their line: a fold over (y, x, idx) from each line's first."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_number ORDER BY y, x, idx) AS n FROM regions WHERE {where}),
f AS (SELECT video_id, frame_number, n, y AS anchor, 0 AS line_no FROM o WHERE n = 1
  UNION ALL SELECT o.video_id, o.frame_number, o.n, CASE WHEN abs(o.y - f.anchor) {breaks} THEN o.y ELSE f.anchor END, f.line_no + (abs(o.y - f.anchor) {breaks})::INT
  FROM f JOIN o ON o.video_id = f.video_id AND o.frame_number = f.frame_number AND o.n = f.n + 1),
lined AS (SELECT o.*, f.line_no FROM o JOIN f USING (video_id, frame_number, n))"""


FRAMES_TEXT = "ft AS (SELECT conv_id AS video_id, turn AS frame_number, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS full_text FROM conversations)"
LCS = "list_reduce(list_prepend(list_resize([0]::BIGINT[], length({b}) + 1, 0), [[string_ord(c)]::BIGINT[] FOR c IN string_split({a}, '')]), lambda row, ch: list_reduce(list_prepend([0]::BIGINT[], [[j]::BIGINT[] FOR j IN range(1, length({b}) + 1)]), lambda out, jj: list_append(out, CASE WHEN ascii({b}[jj[1]:jj[1]]) = ch[1] THEN row[jj[1]] + 1 ELSE greatest(row[jj[1] + 1], out[-1]) END)))[-1]"


def ratio(a: str, b: str) -> str:
    """Of ASCII texts that aren't empty."""
    lcs = LCS.replace("{a}", a).replace("{b}", b).replace("string_ord", "ascii")
    return f"(2.0::DOUBLE * {lcs} / (length({a}) + length({b})))"


#: One entry of a transcript as JSON, and statistics; strings by to_json.
ENTRY_JSON = """'{"speaker":' || to_json(speaker) || ',"timestamp":' || to_json("timestamp") || ',"timestamp_seconds":' || timestamp_seconds || ',"text":' || to_json(text) || ',"confidence":0.0}'"""
RAW_WORDS = "raw_words AS (SELECT o_orderkey % 50 AS video_id, o_orderkey % 9 AS frame_number, o_orderkey AS idx, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 = 1 THEN ' ' || chr(9) || ' ' WHEN o_orderkey % 7 = 2 THEN ' a b' || o_orderkey || chr(10) ELSE 'w' || o_orderkey END AS text, o_orderkey AS k FROM orders)"
IMAGES = """shapes AS (SELECT o_orderkey AS image_id, o_orderkey % 3 + 4 AS width, o_orderkey % 2 + 3 AS height FROM orders),
bytes AS (SELECT image_id, width, height, i, (image_id * 31 + i * i * 17 + i * 7 + image_id % 5 * i) % 256 AS v FROM (SELECT *, unnest(range(width * height * 3)) AS i FROM shapes)),
pixels AS (SELECT image_id, width, height, i // 3 AS p, max(v) FILTER (i % 3 = 0) AS b, max(v) FILTER (i % 3 = 1) AS g, max(v) FILTER (i % 3 = 2) AS r FROM bytes GROUP BY ALL),
grey AS (SELECT *, (b * 1868 + g * 9617 + r * 4899 + 8192) // 16384 AS level FROM pixels)"""
