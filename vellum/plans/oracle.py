"""DuckDB SQL for the engine's queries, written apart from the Spark code."""

from __future__ import annotations

from .literals import values

S = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
W = r"[\p{L}\p{N}_]"
N = r"[^\p{L}\p{N}_]"
ENDS = r"\r\n|[\n\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def dense(x: str) -> str:
    return f"regexp_replace({x}, '{S}+', '', 'g')"


def words(x: str) -> str:
    out = rf"regexp_replace(regexp_replace({x}, '[\x{{e001}}-\x{{e00b}}]', '', 'g'), '[-\x{{ad}}]{S}*\n{S}*', '', 'g')"
    for _ in range(2):
        out = rf"regexp_replace({out}, '({W})[-\x{{ad}}]({W})', '\1\2', 'g')"
    return f"regexp_extract_all(lower({out}), '{W}+')"


def letters(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z]{{3,}}'), lambda w: lower(w))"


LINES = f"""
split AS (SELECT doc_id, source, list_filter(list_transform(regexp_split_to_array(text, '{ENDS}'), lambda x: {strip("x")}), lambda x: x <> '') AS l FROM documents),
numbered AS (SELECT doc_id, source, l, unnest(range(len(l))) AS i FROM split),
lines AS (SELECT doc_id, source, CAST(i AS INTEGER) AS block_index, l[i + 1] AS text, least(792.0, i * (CAST(792.0 AS DOUBLE) / len(l))) AS y0,
  least(792.0, least(792.0, i * (CAST(792.0 AS DOUBLE) / len(l))) + CAST(792.0 AS DOUBLE) / len(l)) AS y1 FROM numbered)"""
ARTIFACT = "(y1 <= 792 * CAST(0.08 AS DOUBLE) OR y0 >= 792 * CAST(0.92 AS DOUBLE))"
SYMBOLS = r"'[^\p{L}\p{Nl}\p{No}]+'"
NOISE = rf"""CASE WHEN d = '' THEN true WHEN length(d) <= 4 AND regexp_full_match(d, '(?i)[0-9&gs]+') THEN true {{ocr}}
  WHEN regexp_matches(d, '[A-Za-z]') THEN false WHEN length(d) <= 6 THEN true ELSE regexp_full_match(d, {SYMBOLS}) END"""
GARBLE = f"WHEN (length(d) >= 3 AND replace(d, left(d, 1), '') = '') OR (length(d) <= 3 AND regexp_full_match(d, '{N}+')) THEN true"


def paragraphs(source: str, page: str, order: str, moved: str = "false") -> str:
    """Paragraph assembly over `source` (page keys, order, text): common table expression `paras`."""
    w = f"OVER (PARTITION BY {page} ORDER BY {order})"
    return rf"""
marked AS (SELECT *, lag(text) {w} AS before, regexp_matches(text, '^[\p{{Ll}}ªº]') AS low, {moved.replace("{w}", w)} AS moved FROM {source}),
opened AS (SELECT *, coalesce(before IS NULL OR moved OR (NOT low AND regexp_matches(before, '[.!?]$')), true) AS opens FROM marked),
glued AS (SELECT *, coalesce(NOT opens AND low AND regexp_matches(before, '-$'), false) AS hyphen,
  CAST(sum(CAST(opens AS INTEGER)) OVER (PARTITION BY {page} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM opened),
pieces AS (SELECT *, CASE WHEN coalesce(lead(hyphen) {w}, false) THEN regexp_replace(text, '-$', '') ELSE text END AS own FROM glued),
paras AS (SELECT {page}, paragraph, count(*) AS n_lines, {strip(f"string_agg(CASE WHEN opens OR hyphen THEN '' ELSE ' ' END || own, '' ORDER BY {order})")} AS text
  FROM pieces GROUP BY {page}, paragraph)"""


STATS = f"""SELECT source, count(*) AS paragraph_count, avg(CAST(regexp_matches(s, '^[\\p{{Ll}}ªº]') AS DOUBLE)) AS lowercase_start_ratio,
  CAST(trunc(median(length(s))) AS INTEGER) AS median_chars, CAST(sum(CAST(length(s) < 40 AS BIGINT)) AS BIGINT) AS under_40_chars,
  CAST(sum(CAST(length({dense("s")}) <= 3 AND regexp_full_match({dense("s")}, {SYMBOLS}) AS BIGINT)) AS BIGINT) AS junk_count
FROM (SELECT source, {strip("text")} AS s FROM paras) WHERE s <> '' GROUP BY source"""


def counted(name: str, source: str, found: str, key: str = "") -> str:
    keys = f"{key}, " if key else ""
    return f"{name} AS (SELECT {keys}token, count(*) AS n FROM (SELECT {keys}unnest({found}) AS token FROM {source}) GROUP BY ALL)"


BENCHMARK = f"{counted('e', 'benchmark', letters('text'))}, {counted('p', 'documents', letters('text'))}, sides AS (SELECT token, coalesce(e.n, 0) AS e, coalesce(p.n, 0) AS p FROM e FULL JOIN p USING (token))"
RECALL = f"""WITH {LINES}, kept AS (SELECT * FROM lines WHERE NOT {ARTIFACT}), {paragraphs("kept", "source, doc_id", "block_index")},
{counted("given", "documents", words("text"), "source")}, {counted("dropped", f"(SELECT * FROM lines WHERE {ARTIFACT})", words("text"), "source")},
{counted("made", "paras", words("text"), "source")},
expected AS (SELECT source, token, given.n - coalesce(dropped.n, 0) AS n FROM given LEFT JOIN dropped USING (source, token) WHERE given.n > coalesce(dropped.n, 0)),
sides AS (SELECT source, token, coalesce(expected.n, 0) AS e, coalesce(made.n, 0) AS p FROM expected FULL JOIN made USING (source, token)),
found AS (SELECT source, CAST(sum(e) AS BIGINT) AS reference_tokens, CAST(sum(least(e, p)) AS BIGINT) AS overlap_tokens FROM sides GROUP BY source)"""

_COLLAPSED = strip(f"regexp_replace(text, '{S}+', ' ', 'g')")
#: Documents of one page and conversations with a page for each turn, as judged lines.
FLOW = f"""base AS (SELECT 'd' || doc_id AS doc_id, 1 AS page_number, text FROM documents UNION ALL SELECT 'c' || conv_id, CAST(turn + 1 AS INTEGER), text FROM conversations),
split AS (SELECT doc_id, page_number, list_filter(list_transform(regexp_split_to_array(text, '{ENDS}'), lambda x: {strip("x")}), lambda x: x <> '') AS l FROM base),
numbered AS (SELECT doc_id, page_number, l, unnest(range(len(l))) AS i FROM split),
raw AS (SELECT doc_id, page_number, i AS block_index, l[i + 1] AS text, least(792.0, i * (CAST(792.0 AS DOUBLE) / len(l))) AS y0,
  least(792.0, least(792.0, i * (CAST(792.0 AS DOUBLE) / len(l))) + CAST(792.0 AS DOUBLE) / len(l)) AS y1 FROM numbered),
lines AS (SELECT * FROM (SELECT doc_id, page_number, block_index, {_COLLAPSED} AS text, y0, y1 FROM raw) WHERE text <> ''),
extent AS (SELECT doc_id, count(DISTINCT page_number) AS k FROM lines GROUP BY doc_id),
often AS (SELECT doc_id, text, count(DISTINCT page_number) AS n FROM lines WHERE y1 <= 792 * CAST(0.05 AS DOUBLE) OR y0 >= 792 * (1 - CAST(0.05 AS DOUBLE)) GROUP BY ALL),
repeated AS (SELECT doc_id, text FROM often JOIN extent USING (doc_id) WHERE n >= greatest(2, ceil(CAST(0.3 AS DOUBLE) * k))),
marked AS (SELECT lines.*, repeated.text IS NOT NULL AS again, regexp_matches(lines.text, '(?i)^\\s*([0-9]+|[ivxlcdm]+)\\s*$') AS number, {dense("lines.text")} AS d FROM lines LEFT JOIN repeated ON repeated.doc_id = lines.doc_id AND repeated.text = lines.text)"""

_QUOTES = "[\"''”’]+$"
_UNQUOTED = strip(f"regexp_replace({strip('ahead')}, '{_QUOTES}', '')")
_END = rf"({N}|$)"
_NUM = "[0-9ivxlcdm]+"
CHAPTER = "|".join(
    [
        rf"^(chapter|part)\s+({_NUM}|one|two|three|four|five|six|seven|eight|nine|ten){_END}",
        rf"^kapitel\s+({_NUM}|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zehn){_END}",
        rf"^chapitre\s+({_NUM}|un|deux|trois|quatre|cinq|six|sept|huit|neuf|dix){_END}",
        rf"^cap[ií]tulo\s+({_NUM}|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez){_END}",
        rf"^capitolo\s+({_NUM}|uno|due|tre|quattro|cinque|sei|sette|otto|nove|dieci){_END}",
        rf"^(prologue|epilogue|appendix|preface|foreword|introduction|prolog|epilog|vorwort|einleitung|anhang|épilogue|préface|annexe){_END}",
        rf"^(pr[óo]logo|ep[íi]logo|prefacio|introducci[óo]n|ap[ée]ndice|пролог|эпилог|предисловие|введение|приложение){_END}",
        rf"^глава\s+{_NUM}|^第[0-9一二三四五六七八九十百千]+[章节部回]|^(序章|序言|前言|引言|附录|尾声)",
    ]
)

ORACLE_SQL: dict[str, str] = {
    "paragraph_quality": f"""WITH {LINES}, clean AS (SELECT * FROM (SELECT *, {dense("text")} AS d FROM lines) WHERE NOT {ARTIFACT}
      AND NOT regexp_matches(text, '(?i)^\\s*([0-9]+|[ivxlcdm]+)\\s*$') AND NOT {NOISE.replace("{ocr}", "")}), {paragraphs("clean", "source, doc_id", "block_index")} {STATS}""",
    "line_block_scan": f"WITH {LINES} SELECT doc_id, block_index, text, y0, y1 FROM lines",
    "margin_artifacts": f"WITH {LINES} SELECT doc_id, block_index, text FROM lines WHERE {ARTIFACT}",
    "paragraph_assembly": f"WITH {LINES}, {paragraphs('lines', 'source, doc_id', 'block_index')} SELECT doc_id, paragraph, n_lines, text FROM paras",
    "paragraph_assembly_cases": f"""WITH {values("blocks")}, edge AS (SELECT doc_id, page_number, min(x0) AS a, max(x0) AS b, max(x1 - x0) AS w, max(width) AS pw FROM blocks GROUP BY ALL),
      placed AS (SELECT blocks.*, CASE WHEN w <= pw * CAST(0.55 AS DOUBLE) AND b > a AND b - a >= greatest(80.0, pw * CAST(0.12 AS DOUBLE)) AND x0 >= (a + b) / 2 THEN 1 ELSE 0 END AS col FROM blocks JOIN edge USING (doc_id, page_number)),
      {paragraphs("placed", "doc_id, page_number", "ord", "(abs(x0 - lag(x0) {w}) > 24 OR col <> lag(col) {w})")} SELECT doc_id, page_number, paragraph, n_lines, text FROM paras""",
    "junk_paragraphs": rf"""WITH {values("texts")} SELECT id, text FROM (SELECT *, {dense("text")} AS d FROM texts) WHERE d <> '' AND
      ((length(d) <= 6 AND regexp_full_match(d, {SYMBOLS})) OR regexp_full_match(d, '(?i)([0-9]+[a-z]+|[a-z]+[0-9]+|[a-z]?[0-9]+[a-z]?|&[a-z0-9]|[&gs]+)'))""",
    "word_counts": f"""SELECT 'documents' AS "of", doc_id AS id, CAST(len({words("text")}) AS INTEGER) AS n_words FROM documents
      UNION ALL SELECT 'conversations', conv_id, CAST(sum(len({words("text")})) AS INTEGER) FROM conversations GROUP BY conv_id""",
    "letters_multiset": f"WITH {counted('c', 'documents', letters('text'))} SELECT token, n FROM c",
    "word_recall_benchmark": f"""WITH {BENCHMARK} SELECT *, overlap_tokens / reference_tokens AS recall FROM (SELECT CAST(sum(e) AS BIGINT) AS reference_tokens, CAST(sum(p) AS BIGINT) AS extracted_tokens,
      CAST(sum(least(e, p)) AS BIGINT) AS overlap_tokens, CAST(sum(greatest(e - p, 0)) AS BIGINT) AS missing_tokens, CAST(sum(greatest(p - e, 0)) AS BIGINT) AS spurious_tokens FROM sides)""",
    "missing_tokens": f"""WITH {counted("e", "documents", letters("text"))}, {counted("p", "conversations", letters("text"))}
      SELECT token, e.n - coalesce(p.n, 0) AS n FROM e LEFT JOIN p USING (token) WHERE e.n > coalesce(p.n, 0)""",
    "spurious_tokens": f"WITH {BENCHMARK} SELECT token, p - e AS n FROM sides WHERE p > e",
    "adjusted_recall": f"{RECALL} SELECT source, reference_tokens, overlap_tokens, CASE WHEN reference_tokens > 0 THEN overlap_tokens / reference_tokens ELSE 1 END AS recall FROM found",
    "conversion_report": f"""{RECALL}, i AS (SELECT source, sum(n) AS i FROM given GROUP BY 1), d AS (SELECT source, sum(n) AS d FROM dropped GROUP BY 1), o AS (SELECT source, sum(n) AS o FROM made GROUP BY 1)
      SELECT source, CAST(i AS BIGINT) AS input_words, CAST(coalesce(d, 0) AS BIGINT) AS dropped_words, CAST(coalesce(o, 0) AS BIGINT) AS output_words,
      CAST(greatest(i - coalesce(d, 0), 0) AS BIGINT) AS expected_words, round(overlap_tokens / reference_tokens, 4) AS recall, round(least(1.0, coalesce(o, 0) / i), 4) AS recall_raw, round(overlap_tokens / reference_tokens, 4) >= CAST(0.98 AS DOUBLE) AS recall_passed
      FROM i LEFT JOIN d USING (source) LEFT JOIN o USING (source) LEFT JOIN found USING (source)""",
    "drop_ledger": f"""WITH {LINES} SELECT doc_id, 'margin_artifact' AS reason, count(*) AS n, CAST(sum(len({words("text")})) AS BIGINT) AS word_count FROM lines WHERE {ARTIFACT} GROUP BY doc_id""",
    "needs_ocr": f"""SELECT *, (char_count < 50 AND 612 * 792 >= 40000) OR bad_glyph_ratio >= CAST(0.3 AS DOUBLE) AS needs_ocr FROM (SELECT doc_id, length(coalesce(text, '')) AS char_count,
      CASE WHEN length({dense("coalesce(text, '')")}) > 0 THEN (length(text) - length(regexp_replace(text, '\\x{{fffd}}|\\(cid:[0-9]+\\)', '', 'g'))) / length({dense("text")}) ELSE 0 END AS bad_glyph_ratio FROM documents)""",
    "repeated_lines": f"""WITH {values("margins")}, t AS (SELECT DISTINCT doc_id, page_number, {strip(f"regexp_replace(text, '{S}+', ' ', 'g')")} AS margin_text FROM margins
      WHERE y1 <= height * CAST(0.05 AS DOUBLE) OR y0 >= height * (1 - CAST(0.05 AS DOUBLE)) OR font >= 36)
      , pages AS (SELECT doc_id, count(DISTINCT page_number) AS k FROM margins GROUP BY doc_id), n AS (SELECT doc_id, margin_text, count(*) AS n FROM t GROUP BY ALL)
      SELECT doc_id, margin_text FROM n JOIN pages USING (doc_id) WHERE n >= greatest(2, ceil(CAST(0.3 AS DOUBLE) * k))""",
    "noise_lines": rf"""WITH {values("texts")} SELECT id, {NOISE.replace("{ocr}", "")} AS is_noise, {NOISE.replace("{ocr}", GARBLE)} AS is_noise_ocr, regexp_matches(text, '(?i)^\s*([0-9]+|[ivxlcdm]+)\s*$') AS is_page_number,
      d <> '' AND NOT regexp_matches(d, '[A-Za-z]') AND NOT regexp_full_match(d, '[*·•.…—–~#-]+') AND (length(d) <= 6 OR regexp_full_match(d, {SYMBOLS})) AS is_qa_junk FROM (SELECT *, {dense("text")} AS d FROM texts)""",
    "heading_candidates": rf"""WITH {values("headings")}, f AS (SELECT *, regexp_matches(text, '(?i){CHAPTER}') AS is_named, regexp_matches(text, '(?i){CHAPTER}') OR regexp_matches(text, '(?i)^chapter\s+[&s](\s|$)') AS named,
      length(text) <= 120 AND (font >= 12 + CAST(1.4 AS DOUBLE) OR font >= 12 * CAST(1.2 AS DOUBLE) OR (length(text) <= 80 AND bold_ratio >= 0.5 AND font > 12)) AS major FROM headings)
      SELECT ord, named OR major AS is_heading, (named OR major) AND (named OR (length(text) < 60 AND font >= 18 AND y0 < height * CAST(0.35 AS DOUBLE))) AS opens_chapter, is_named FROM f""",
    "toc_pages": rf"""WITH {values("toc")}, s AS (SELECT doc_id, page_number, count(*) AS candidates, CAST(sum(CAST(starts_with(lower(text), 'contents') OR regexp_matches(text, '\.\.+\s*[0-9]+\s*$') OR regexp_matches(text, '(?i){CHAPTER}') AS INTEGER)) AS BIGINT) AS entries,
      bool_or(contains(lower(text), 'contents')) AS c, sum(len(regexp_extract_all(lower(text), '\b(chapter|part|appendix)\b'))) AS k FROM toc GROUP BY ALL)
      SELECT doc_id, page_number, candidates, entries, (c AND k >= 3) OR (candidates >= 6 AND entries >= CAST(0.4 AS DOUBLE) * candidates) AS is_toc FROM s""",
    "copyright_pages": rf"""WITH {values("notices")}, pages AS (SELECT doc_id, page_number, lower(string_agg(text, ' ' ORDER BY ord)) AS a FROM notices GROUP BY ALL),
      kept AS (SELECT notices.* FROM notices JOIN pages USING (doc_id, page_number) WHERE page_number <= 12 AND contains(a, 'all rights reserved') AND (contains(a, '©') OR contains(a, 'copyright'))
        AND NOT regexp_matches(text, '(?i)^(isbn(-1[03])?|lccn|library of congress control number|printed in the united states of america)([^\p{{L}}\p{{N}}_]|$)')),
      opened AS (SELECT *, NOT coalesce(regexp_matches(text, '^[\p{{Ll}}ªº]') AND NOT regexp_matches(lag(text) OVER w, '[.!?]$'), false) AS o FROM kept WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY ord)),
      n AS (SELECT *, CAST(sum(CAST(o AS INTEGER)) OVER (PARTITION BY doc_id, page_number ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM opened)
      SELECT doc_id, page_number, paragraph, string_agg(text, ' ' ORDER BY ord) AS text FROM n GROUP BY ALL""",
    "chapter_sequence": rf"""WITH {values("titles")}, n AS (SELECT doc_id, ord, CAST(regexp_extract(title, '(?i)\bchapter\s+([0-9]+)\b', 1) AS INTEGER) AS number FROM titles WHERE regexp_matches(title, '(?i)\bchapter\s+[0-9]+\b')),
      b AS (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM n) SELECT doc_id, ord, number, coalesce(before, -1) AS before, coalesce(number - before > 1, false) AS is_gap, coalesce(number = before, false) AS is_duplicate FROM b""",
    "body_font_mode": f"""WITH {values("spans")}, c AS (SELECT doc_id, round(size, 1) AS s, count(*) AS n, min(ord) AS o FROM spans WHERE {strip("text")} <> '' GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS k FROM c) SELECT d.doc_id, coalesce(r.s, 12.0) AS body_font FROM (SELECT DISTINCT doc_id FROM spans) d LEFT JOIN r ON r.doc_id = d.doc_id AND k = 1""",
    "reading_order": f"""WITH {values("blocks")}, edge AS (SELECT doc_id, page_number, min(x0) AS a, max(x0) AS b, max(x1 - x0) AS w, max(width) AS pw FROM blocks GROUP BY ALL),
      placed AS (SELECT blocks.*, CASE WHEN w <= pw * CAST(0.55 AS DOUBLE) AND b > a AND b - a >= greatest(80.0, pw * CAST(0.12 AS DOUBLE)) AND x0 >= (a + b) / 2 THEN 1 ELSE 0 END AS col FROM blocks JOIN edge USING (doc_id, page_number))
      SELECT doc_id, page_number, ord, col AS "column", CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY col, y0, x0, ord) - 1 AS INTEGER) AS place FROM placed""",
    "blocks_outside_tables": f"""WITH {values("blocks")}, {values("boxes")} SELECT doc_id, page_number, ord FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM boxes t WHERE t.doc_id = b.doc_id AND t.page_number = b.page_number
      AND (b.x0 + b.x1) / 2 BETWEEN t.x0 AND t.x1 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 AND t.y1)""",
    "verse_runs": f"""WITH {values("blocks")}, r AS (SELECT doc_id, page_number, min(ord) AS "first", count(*) AS n_lines, string_agg(text, chr(10) ORDER BY ord) AS text, min(x0) AS x0, arg_min(y0, ord) AS y0, max(x1) AS x1, arg_max(y1, ord) AS y1,
      max(abs((x0 + x1) / 2 - width / 2)) AS off, max((x0 + x1) / 2) - min((x0 + x1) / 2) AS spread, max(x0) - min(x0) AS l, max(x1) - min(x1) AS g, max(x1 - x0) AS w, max(width) AS p FROM blocks WHERE x1 > x0 GROUP BY ALL)
      SELECT doc_id, page_number, "first", n_lines, text, x0, y0, x1, y1 FROM r WHERE n_lines >= 2 AND off <= p * CAST(0.04 AS DOUBLE) AND spread <= p * CAST(0.04 AS DOUBLE) AND l >= p * CAST(0.04 AS DOUBLE) AND g >= p * CAST(0.04 AS DOUBLE) AND w <= p * CAST(0.72 AS DOUBLE)""",
    "image_captions": f"""WITH {values("elements")}, n AS (SELECT *, lead(kind) OVER w AS k, lead(y0) OVER w AS y, lead(font) OVER w AS f, lead("column") OVER w AS c, lead(text) OVER w AS s FROM elements WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY ord)),
      m AS (SELECT *, kind = 'image' AND k = 'line' AND y - y1 BETWEEN 0 AND 2 * body_font AND f <= CAST(0.95 AS DOUBLE) * body_font AND c = "column" AS fits FROM n)
      SELECT doc_id, page_number, ord, kind, CASE WHEN fits THEN s END AS caption, coalesce(lag(fits) OVER (PARTITION BY doc_id, page_number ORDER BY ord), false) AS is_caption FROM m""",
    "archive_path_check": rf"""WITH {values("paths")} SELECT id, path, trim(path) <> '' AND NOT regexp_matches(path, '^[/\\]') AND NOT regexp_matches(path, '^[A-Za-z]:') AND NOT list_contains(string_split(replace(path, '\', '/'), '/'), '..') AS is_safe FROM paths""",
    "redacted_paths": rf"""WITH {values("logs")} SELECT id, regexp_replace(regexp_replace(text, '[a-zA-Z]:[\\/](?:Users|Documents and Settings|home)[\\/][^\\/]+[\\/]', '<sanitized_path>/', 'g'), '/(?:Users|home)/[^/]+/', '<sanitized_path>/', 'g') AS text FROM logs""",
    "image_dedup": f"""WITH {values("images")}, k AS (SELECT chapter, ord, sha256(content) AS image_key, row_number() OVER (PARTITION BY chapter, sha256(content) ORDER BY ord) AS r FROM images) SELECT chapter, ord, image_key FROM k WHERE r = 1""",
    "page_flow_drops": f"""WITH {FLOW},
      toc AS (SELECT doc_id, page_number FROM (SELECT doc_id, page_number, count(*) AS n, sum(CAST(starts_with(lower(text), 'contents') OR regexp_matches(text, '\\.\\.+\\s*[0-9]+\\s*$') OR regexp_matches(text, '(?i){CHAPTER}') AS INTEGER)) AS e,
        bool_or(contains(lower(text), 'contents')) AS c, sum(len(regexp_extract_all(lower(text), '\\b(chapter|part|appendix)\\b'))) AS k FROM marked WHERE NOT again AND NOT number GROUP BY ALL) WHERE (c AND k >= 3) OR (n >= 6 AND e >= CAST(0.4 AS DOUBLE) * n)),
      rights AS (SELECT doc_id, page_number FROM (SELECT doc_id, page_number, lower(string_agg(text, ' ' ORDER BY block_index)) AS a FROM marked WHERE page_number <= 12 GROUP BY ALL) WHERE contains(a, 'all rights reserved') AND (contains(a, '©') OR contains(a, 'copyright'))),
      judged AS (SELECT marked.*, toc.doc_id IS NOT NULL AS is_toc, CASE WHEN again THEN 'running_header_footer' WHEN {ARTIFACT} THEN 'margin_artifact' WHEN number THEN 'page_number' WHEN {NOISE.replace("{ocr}", "")} THEN 'noise_text' END AS why
        FROM marked LEFT JOIN toc USING (doc_id, page_number) LEFT JOIN rights ON rights.doc_id = marked.doc_id AND rights.page_number = marked.page_number WHERE rights.doc_id IS NULL OR toc.doc_id IS NOT NULL),
      gone AS (SELECT doc_id, 'table_of_contents' AS reason, 1 AS n, sum(len({words("text")})) AS w FROM judged WHERE is_toc GROUP BY doc_id, page_number UNION ALL SELECT doc_id, why, 1, len({words("text")}) FROM judged WHERE NOT is_toc AND why IS NOT NULL)
      SELECT doc_id, reason, CAST(sum(n) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS word_count FROM gone GROUP BY ALL""",
    "page_continuation": rf"""WITH split AS (SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page_number, list_filter(list_transform(regexp_split_to_array(text, '{ENDS}'), lambda x: {strip("x")}), lambda x: x <> '') AS l FROM conversations),
      numbered AS (SELECT conv_id, page_number, l, unnest(range(len(l))) AS block_index FROM split), lines AS (SELECT conv_id, page_number, block_index, l[block_index + 1] AS text FROM numbered),
      {paragraphs("lines", "conv_id, page_number", "block_index")},
      seen AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY page_number, paragraph) AS ahead FROM paras),
      held AS (SELECT *, coalesce(text <> '' AND NOT regexp_matches({_UNQUOTED}, '[.!?:]$'), false) AS open FROM seen),
      run AS (SELECT *, bool_and(open) OVER (PARTITION BY conv_id, page_number ORDER BY paragraph ROWS UNBOUNDED PRECEDING) AS goes FROM held),
      led AS (SELECT *, sum(CAST(NOT goes AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY page_number, paragraph ROWS UNBOUNDED PRECEDING) AS head, coalesce(lead(goes) OVER (PARTITION BY conv_id ORDER BY page_number, paragraph), false) AS next FROM run)
      SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY head) - 1 AS INTEGER) AS place, min(page_number) AS page_number,
        string_agg(CASE WHEN next THEN regexp_replace(text, '-$', '') || CASE WHEN regexp_matches(text, '-$') THEN '' ELSE ' ' END ELSE text END, '' ORDER BY page_number, paragraph) AS text FROM led GROUP BY conv_id, head""",
    "cover_classes": f"""WITH {values("visuals")}, m AS (SELECT *, greatest(image_ratio, vector_ratio) AS g, 1 - nonwhite_ratio AS s FROM visuals),
      c AS (SELECT *, (g >= CAST(0.7 AS DOUBLE) OR nonwhite_ratio > CAST(0.85 AS DOUBLE)) AND word_count <= 35 AS cover, s >= CAST(0.7 AS DOUBLE) AND g <= CAST(0.15 AS DOUBLE) AND word_count BETWEEN 1 AND 90 AND block_count >= 2 AND word_count / block_count <= 14 AND vertical_span_ratio >= 0.25 AS title FROM m)
      SELECT doc_id, page_number, CASE WHEN cover THEN 'COVER_IMAGE' WHEN title THEN 'TITLE_PAGE' ELSE 'NONE' END AS kind, coalesce(round(least(CASE
        WHEN cover THEN CAST(0.6 AS DOUBLE) + CAST(0.3 AS DOUBLE) * least(1.0, greatest((g - CAST(0.7 AS DOUBLE)) / (1 - CAST(0.7 AS DOUBLE)), (nonwhite_ratio - CAST(0.85 AS DOUBLE)) / (1 - CAST(0.85 AS DOUBLE)), 0.0)) + CASE WHEN word_count <= 15 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END
        WHEN title THEN CAST(0.55 AS DOUBLE) + CAST(0.2 AS DOUBLE) * least(1.0, (s - CAST(0.7 AS DOUBLE)) / (1 - CAST(0.7 AS DOUBLE))) + CASE WHEN vertical_span_ratio >= CAST(0.4 AS DOUBLE) THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END + CASE WHEN block_count >= 3 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
        END, CAST(0.99 AS DOUBLE)), 3), 0) AS confidence FROM c""",
}
ORACLE_SQL["cover_pages"] = f"""WITH classes AS ({ORACLE_SQL["cover_classes"]}), early AS (SELECT * FROM classes WHERE page_number <= 3),
  covers AS (SELECT doc_id, min(page_number) FILTER (kind = 'COVER_IMAGE') AS cover_page FROM early GROUP BY doc_id)
  SELECT doc_id, coalesce(any_value(cover_page), 0) AS cover_page, coalesce(min(page_number) FILTER (kind = 'TITLE_PAGE' AND (cover_page IS NULL OR page_number > cover_page)), 0) AS title_page FROM early JOIN covers USING (doc_id) GROUP BY doc_id"""
