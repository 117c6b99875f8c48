"""SQL of the text queries. RE2 has no look-around and no back-references: cuts go by a mark, repeats by lists of characters."""

from __future__ import annotations

from lodestrata.functions import text as T
from lodestrata.operators import augment, layout, pages
from lodestrata.operators.chunks import FIXED_SIZE, LEAST, MOST, OVERLAP, SIZE

WHITE, CUT = T.WHITE, "chr(1)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


def left_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WHITE}]+', '')"


def cut_sentences(x: str) -> str:
    """The pieces of a text between white space that follows a mark and comes before Hangul, a capital or a quote."""
    return f"""string_split(regexp_replace({x}, '([.!?])[{WHITE}]+([가-힣A-Z"])', '\\1' || {CUT} || '\\2', 'g'), {CUT})"""


def sentences(x: str, least: int = 1) -> str:
    return f"list_filter(list_transform({cut_sentences(x)}, lambda s: trim(s)), lambda s: length(s) >= {least})"


SENTENCES = f"""WITH s AS (SELECT doc_id, {sentences('text')} AS s FROM documents)
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sentence_no, unnest(s) AS sentence FROM s"""


def _chrome(x: str) -> str:
    for p in T.CHROME:
        x = f"regexp_replace({x}, '(?s){p}', '', 'g')"
    return x


_QUOTED = T.KEPT_MARKS.replace("'", "''")

_HEAD = " OR ".join(f"regexp_matches(t, '^{a}[0-9]{{{n},}}{z}$')" for a, z, n in T.NUMBERED_HEADS)
_LISTED = "|".join(T.LISTED)
CLEAN_OCR = f"""WITH a AS (SELECT doc_id, regexp_replace({_chrome(f"regexp_replace({strip('text')}, '[{T.CONTROLS}]', '', 'g')")}, '[^{T.LETTERS}{WHITE}{_QUOTED}]', ' ', 'g') AS a FROM documents),
c AS (SELECT doc_id, string_split(a, '') AS c, len(string_split(a, '')) AS n FROM a),
k AS (SELECT doc_id, array_to_string(list_filter(c, lambda x, i: x = chr(10) OR i = 1 OR x <> c[i - 1] OR ((i = 2 OR c[i - 2] <> x) AND (i = n OR c[i + 1] <> x))), '') AS k FROM c),
l AS (SELECT doc_id, string_split(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(k, '[ \\t]+', ' ', 'g'), chr(10)), lambda x: {strip('x')}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS l FROM k),
e AS (SELECT doc_id, generate_subscripts(l, 1) AS no, unnest(l) AS line FROM l),
h AS (SELECT *, {strip('line')} AS t, {left_strip('line')} AS body FROM e),
w AS (SELECT *, length(line) - length(body) AS n, regexp_extract(body, '^[0-9]+[.)]', 0) AS number FROM h
  WHERE t = '' OR NOT (regexp_matches(t, '^[0-9]+$') OR t IN ({', '.join(f"'{x}'" for x in T.HEADS)}) OR {_HEAD} OR (length(t) <= 3 AND NOT regexp_matches(t, '^[0-9{WHITE}{T.MARKS}]+$')))),
b AS (SELECT doc_id, no, CASE WHEN body = '' THEN line WHEN contains('{T.BULLETS}', substr(body, 1, 1)) THEN repeat(' ', n) || '• ' || {left_strip('substr(body, 2)')} WHEN contains('{T.DASHES}', substr(body, 1, 1)) THEN repeat(' ', n) || '- ' || {left_strip('substr(body, 2)')}
  WHEN number <> '' THEN repeat(' ', n) || number || {left_strip('substr(body, length(number) + 1)')}
  WHEN (length(t) <= 30 AND NOT regexp_matches(t, '^[A-Z{WHITE}]+$') AND regexp_matches(t, '{_LISTED}')) OR (ends_with(t, ':') AND (length(t) <= 50 OR regexp_matches(t, '^[가-힣:{WHITE}]+$'))) THEN repeat(' ', n) || '• ' || t ELSE line END AS line FROM w)
SELECT documents.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY no), '') END AS cleaned FROM documents LEFT JOIN b ON b.doc_id = documents.doc_id GROUP BY documents.doc_id, text"""


def _title(x: str) -> str:
    data = f"regexp_matches({x}, '[0-9]+.*[-–—].*[0-9]+') OR regexp_matches({x}, '(?:수도권|광역시|기타|서울|경기|인천).*[0-9]+') OR regexp_matches({x}, '구분.*[0-9]+')"
    return f"(NOT ({data}) AND (regexp_matches(trim({x}), '^\\*\\*.*\\*\\*$') OR ends_with({x}, ':') OR regexp_matches({x}, '^[0-9]+[.)]') OR length({x}) <= 30))"


PARAGRAPH_TYPES = f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line FROM s),
p AS (SELECT *, trim(line) AS first, {sentences('line', 5)} AS parts FROM e WHERE trim(line) <> ''),
f AS (SELECT *, list_reduce(parts, lambda a, s: CASE WHEN a.size + length(s) > 800 AND a.held > 0 THEN {{'done': a.done + 1, 'held': 1, 'size': length(s)}} ELSE {{'done': a.done, 'held': a.held + 1, 'size': a.size + length(s)}} END,
  {{'done': 0::BIGINT, 'held': 0::BIGINT, 'size': 0::BIGINT}}) AS fold FROM p)
SELECT doc_id, line_no, CASE WHEN starts_with(line, '=== 표') AND ends_with(line, '===') THEN 'table' WHEN {_title('line')} THEN 'title' WHEN regexp_matches(line, '^(?:[•·▪▫□◦‣⁃\\-–—]|[0-9]+[.)])') THEN 'list' ELSE 'paragraph' END AS kind,
  CASE WHEN {_title('first')} THEN first ELSE substr(line, 1, 50) || CASE WHEN length(line) > 50 THEN '...' ELSE '' END END AS title,
  CASE WHEN regexp_matches(line, '^[0-9]+\\.\\s+') THEN 1 WHEN regexp_matches(line, '^[0-9]+\\.[0-9]+\\.\\s+') THEN 2 WHEN regexp_matches(line, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.\\s+') THEN 3 WHEN regexp_matches(line, '^[가-힣\\s]+:$') THEN 1 ELSE 0 END AS level,
  CAST(CASE WHEN length(line) <= 800 OR len(parts) = 0 THEN 1 ELSE fold.done + CASE WHEN fold.held > 0 THEN 1 ELSE 0 END END AS INTEGER) AS n_pieces FROM f"""


def _replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, new in pairs:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


_CLEAN = _replaced(
    "text",
    [
        ("<[^>]*>", ""), ("\\*\\*", ""), ("#+\\s*", ""), ("(?m)^[0-9]+\\.\\s*", ""), (f"[{WHITE}]+", " "), ("^\\s*안녕하세요[.,]?\\s*([가-힣\\s]*님[.,]?\\s*)?", " "), ("\\s*안녕하세요[.,]?\\s*", " "),
        ("^\\s*질문[에대한]?\\s*[답변안내]+[.:]\\s*", " "), ("^\\s*문서에\\s*따르면[.,]?\\s*", " "), ("^\\s*제공된\\s*문서[에의하면]*[.,]?\\s*", " "), ("\\([^)]*\\)", ""), (f"[{WHITE}]+", " "),
    ],
)
_AT = lambda m: f"CASE WHEN contains(h, '{m}') THEN length(regexp_extract(h, '(?s)^.*{m}', 0)) - 1 ELSE -1 END"
_ENDS = ", ".join(_AT("\\" + m if m == "." else m).replace("contains(h, '\\.')", "contains(h, '.')") for m in (" ", ".", ",", ":", "에", "의", "를", "을", "와", "과"))
TITLES = f"""WITH c AS (SELECT conv_id, turn, trim({_CLEAN}) AS c, trim({_replaced('text', [('<[^>]*>', ''), (f'[{WHITE}]+', ' ')])}) AS p FROM conversations),
h AS (SELECT *, substr(c, 1, 25) AS h, regexp_extract(p, '^[^.!?]*', 0) AS first FROM c),
a AS (SELECT *, {_AT(' ')} AS blank, greatest({_ENDS}) AS best, list_filter(string_split_regex(first, '[{WHITE}]+'), lambda w: w <> '') AS ws FROM h)
SELECT conv_id, turn, CASE WHEN length(c) <= 25 THEN c WHEN length(c) <= 30 THEN CASE WHEN blank > 15 THEN substr(h, 1, blank) ELSE h END END AS short,
  CASE WHEN length(c) <= 25 THEN c WHEN best >= 12 THEN trim(substr(h, 1, best)) WHEN blank >= 10 THEN trim(substr(h, 1, blank)) ELSE trim(h) END AS cut,
  CASE WHEN length(first) <= 25 THEN first ELSE substr(array_to_string(list_filter(ws, lambda w, i: list_sum(list_transform(ws[1:i], lambda x: length(x))) + i - 1 <= 24), ' '), 1, 25) END AS fallback FROM a"""


def plain(html: str) -> str:
    """Text of a page without its frame, tags and entities."""
    frame = "|".join(f"<{t}\\b.*?</{t}\\s*>" for t in ("script", "style", "noscript", "header", "footer", "nav", "aside"))
    x = f"regexp_replace({html}, '(?is){frame}|<!--.*?-->', ' ', 'g')"
    for name, c in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{c}')"
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '[{WHITE}]+', ' ', 'g'))"


#: Ten words a line; a heading starts a paragraph and ends it.
PAGE_LINES = f"""WITH w AS (SELECT url AS file, page_id AS page, list_filter(string_split({plain('html')}, ' '), lambda x: x <> '') AS w FROM pages), e AS (SELECT file, page, generate_subscripts(w, 1) - 1 AS n, unnest(w) AS w FROM w),
l AS (SELECT file, page, n // 10 AS line_no, string_agg(w, '' ORDER BY n) AS line FROM e GROUP BY file, page, n // 10),
h AS (SELECT *, CASE WHEN regexp_matches(trim(line), '{layout.HEADINGS}') THEN 1 ELSE 0 END AS head FROM l),
b AS (SELECT *, greatest(head, coalesce(lag(head) OVER (PARTITION BY file, page ORDER BY line_no), 0)) AS b FROM h), p AS (SELECT *, sum(b) OVER (PARTITION BY file, page ORDER BY line_no) AS no FROM b)
SELECT file, page, CAST(no AS BIGINT) AS paragraph_no, string_agg(line, ' ' ORDER BY line_no) AS text FROM p GROUP BY file, page, no"""


#: Pieces (doc_id, no, piece) as chunks: blank ones go, the others are numbered.
NUMBERED = f"""k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, trim(piece) AS content FROM pieces WHERE {strip('piece')} <> '')"""
_HALF = f"substr(rest, 1, {FIXED_SIZE})"
CHUNK_CHARS = f"""WITH RECURSIVE w AS (SELECT doc_id, 0 AS no, text AS rest, '' AS piece, false AS done FROM documents WHERE {strip('text')} <> ''
  UNION ALL SELECT doc_id, no + 1, CASE WHEN length(rest) > {FIXED_SIZE} THEN substr(rest, greatest(e - {OVERLAP}, 1) + 1) ELSE '' END, CASE WHEN length(rest) > {FIXED_SIZE} THEN substr(rest, 1, e) ELSE rest END, length(rest) <= {FIXED_SIZE}
  FROM (SELECT *, CASE WHEN length(regexp_extract({_HALF}, '(?s)^.*[.。?!]', 0)) - 1 > {FIXED_SIZE // 2} THEN length(regexp_extract({_HALF}, '(?s)^.*[.。?!]', 0)) ELSE {FIXED_SIZE} END AS e FROM w WHERE NOT done)),
pieces AS (SELECT doc_id, no, piece FROM w WHERE no > 0), {NUMBERED} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(total_chunks AS INTEGER) AS total_chunks, content FROM k"""


def sentence_pieces(rows: str) -> str:
    """CTE ``sp`` (doc_id, out: list of chunks) of rows (doc_id, text)."""
    join = "CASE WHEN a.held = '' THEN s ELSE a.held || ' ' || s END"
    tail = f"CASE WHEN a.n > 1 AND length(a.held) > {OVERLAP} THEN substr(a.held, length(a.held) - {OVERLAP - 1}) ELSE '' END"
    state = lambda out, held, n, used: f"{{'out': {out}, 'held': {held}, 'n': {n}, 'used': {used}}}"
    long = state(f"list_concat(CASE WHEN a.n > 0 THEN list_append(a.out, a.held) ELSE a.out END, list_transform(range(0, length(s), {SIZE}), lambda i: substr(s, CAST(i + 1 AS BIGINT), {SIZE})))", "''", "0::BIGINT", "0::BIGINT")
    full = state("list_append(a.out, a.held)", f"CASE WHEN {tail} = '' THEN s ELSE {tail} || ' ' || s END", f"CASE WHEN {tail} = '' THEN 1 ELSE 2 END", f"length({tail}) + length(s)")
    more = state("a.out", join, "a.n + 1", "a.used + length(s)")
    return f"""ss AS (SELECT doc_id, text, list_filter(list_transform({cut_sentences('text')}, lambda s: {strip('s')}), lambda s: s <> '') AS ss FROM ({rows}) WHERE {strip('text')} <> ''),
sf AS (SELECT doc_id, text, list_reduce(ss, lambda a, s: CASE WHEN length(s) > {MOST} THEN {long} WHEN a.n > 0 AND a.used + length(s) > {SIZE} THEN {full} ELSE {more} END, {state("[]::VARCHAR[]", "''", "0::BIGINT", "0::BIGINT")}) AS f FROM ss),
sp AS (SELECT doc_id, CASE WHEN length(text) < {LEAST} THEN [text] ELSE list_transform(CASE WHEN f.n > 0 THEN list_append(f.out, f.held) ELSE f.out END, lambda c: {strip('c')}) END AS out FROM sf)"""


def numbered(lists: str) -> str:
    return f"pieces AS (SELECT doc_id, generate_subscripts(out, 1) AS no, unnest(out) AS piece FROM {lists}), {NUMBERED}"


CHUNK_SENTENCES = f"""WITH {sentence_pieces("SELECT doc_id, text FROM documents")}, {numbered("sp")} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(total_chunks AS INTEGER) AS total_chunks, content FROM k"""

_HEADER = "array_to_string(l[1:3], chr(10))"
CHUNK_SECTIONS = f"""WITH d AS (SELECT doc_id || '_s1' AS doc_id, CASE WHEN coalesce(source, '') <> '' THEN source || chr(10) || chr(10) || text ELSE text END AS text FROM documents), {sentence_pieces("SELECT doc_id, text FROM d")},
t AS (SELECT doc_id || '_s2' AS doc_id, list_concat(['| h |', '|---|'], list_transform(string_split(text, chr(10)), lambda x: '| ' || x || ' |')) AS l FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, l, {_HEADER} AS top, list_reduce(l[4:], lambda a, s: CASE WHEN a.n > 0 AND a.used + length(s) > {SIZE} THEN {{'out': list_append(a.out, a.held), 'held': s, 'n': 1::BIGINT, 'used': length({_HEADER}) + length(s)}}
  ELSE {{'out': a.out, 'held': CASE WHEN a.n = 0 THEN s ELSE a.held || chr(10) || s END, 'n': a.n + 1, 'used': a.used + length(s)}} END, {{'out': []::VARCHAR[], 'held': '', 'n': 0::BIGINT, 'used': length({_HEADER})}}) AS f FROM t),
tp AS (SELECT doc_id, CASE WHEN length(array_to_string(l, chr(10))) <= {MOST} THEN [array_to_string(l, chr(10))] ELSE list_transform(CASE WHEN f.n > 0 THEN list_append(f.out, f.held) ELSE f.out END, lambda x: top || chr(10) || x) END AS out FROM tf),
pairs AS (SELECT * FROM sp UNION ALL SELECT * FROM tp), {numbered("pairs")}
SELECT doc_id || '_' || chunk_index AS chunk_id, string_split(doc_id, '_')[1] AS file_name, string_split(doc_id, '_')[2] AS section_id, CAST(CASE WHEN ends_with(doc_id, 's1') THEN 0 ELSE 1 END AS INTEGER) AS section_no,
  CASE WHEN ends_with(doc_id, 's1') THEN 'text' ELSE 'table' END AS chunk_type, CAST(chunk_index AS INTEGER) AS chunk_index, content FROM k"""

_TITLE = f"trim(regexp_replace(nullif({plain('regexp_extract(html, $$(?is)<title[^>]*>(.*?)</title>$$, 1)')}, ''), '\\s*[|\\-–:]\\s*[^|\\-–:]*$', ''))"


def _first(options: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in options) + ")"


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def _cell(label: str) -> str:
    return plain(f"regexp_extract(html, '(?is)<th[^>]*>[^<]*{label}[^<]*</th>\\s*<td[^>]*>(.*?)</td>', 1)")


_PLACE = "[가-힣]+(?:특별시|광역시|시|도)\\s+[가-힣]+구\\s+"
_FORM = " ".join(f"WHEN contains(plain, '{x}') THEN '{x}'" for x in pages.FORMS)
_AMENITIES = ", ".join(f"CASE WHEN regexp_matches(plain, '{p}') THEN '{k}' END" for k, p in pages.AMENITIES.items())
_DATE = "regexp_extract(plain, '최종수정일\\s*:\\s*([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}\\.[0-9]{2}\\.[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2})', 1)"


def squeezed(x: str, join_letters: bool = False) -> str:
    x = f"regexp_replace(regexp_replace({x}, '[{WHITE}]+', ' ', 'g'), '\\s+([.,!?])', '\\1', 'g')"
    letter = "([\\p{L}\\p{M}\\p{Nl}\\p{Nd}\\p{Pc}])"
    return f"trim(regexp_replace({x}, '{letter}\\s+{letter}', '\\1\\2', 'g'))" if join_letters else f"trim({x})"


_SHAPES = ("(?s)(?:입주자격|신청자격|자격요건|입주대상)\\s*[:：]\\s*(.+)$", "(?:입주자격|신청자격|자격|대상)\\s*\\(([^)]+)\\)", "(?:자격|대상)\\s*[:：]?\\s*([^\\n]+)")
_ELIGIBILITY = _first([squeezed(f"regexp_extract(plain, '{s}', 1)") for s in _SHAPES])
_STATIONS = [f"regexp_extract_all(plain, '{pages.SUBWAY}', {g})" for g in range(1, 7)]
_ACCESS = "coalesce('도보 ' || nullif(r[3], '') || '분', '도보 ' || nullif(r[4], '') || '초', '버스 ' || nullif(r[5], '') || '분', nullif(r[6], '') || 'm')"
PAGE_FIELDS = f"""WITH p AS (SELECT *, {plain('html')} AS plain, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin FROM pages),
m AS (SELECT *, regexp_extract_all(plain, '[0-9][0-9,]*\\s*(?:만원|원)') AS money, regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']+\\.(?:{pages.EXTENSIONS}))["'']', 1) AS files,
  list_transform(list_zip({', '.join(_STATIONS)}), lambda r: concat_ws(' ', nullif(r[1], '') || '호선', r[2], {_ACCESS})) AS stations FROM p)
SELECT page_id, coalesce(nullif({_TITLE}, ''), url) AS name, CASE {_FORM} ELSE {_first([f"regexp_extract(plain, '{pages.ROOMS}')", "substr(trim(plain), 1, 50)"])} END AS form, nullif(translate({_DATE}, './', '--'), '') AS modified,
  {_first([f"trim({_first([_cell('주소'), _cell('소재지')])})", f"regexp_extract(plain, '{_PLACE}[가-힣0-9]+(?:로|길)\\s*[0-9]+(?:-[0-9]+)?')", f"regexp_extract(plain, '{_PLACE}[가-힣0-9]+동\\s+[0-9]+(?:-[0-9]+)?')"])} AS address,
  array_to_string(list_filter([{_AMENITIES}], lambda x: x IS NOT NULL), ',') AS amenities, array_to_string({_distinct('money')}, ',') AS money, CAST(len(list_distinct(files)) AS INTEGER) AS n_files, {_ELIGIBILITY} AS eligibility,
  array_to_string({_distinct('stations')}, ', ') AS stations FROM m"""


def _lay(name: str, part: str, head: str, tail: str = "''", nothing: str | None = None, rows: str = "kept") -> str:
    return f"""SELECT '{name}' AS layout, query_id, CASE WHEN body IS NULL THEN {nothing or head} ELSE {head} || body || {tail} END AS context FROM q LEFT JOIN (SELECT query_id, string_agg({part}, '' ORDER BY rank) AS body FROM {rows} GROUP BY query_id) USING (query_id)"""


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def contexts(candidates: str) -> str:
    """Every layout of each item's context: the five best of ``candidates`` within the budget of words."""
    no, three, percent, nothing = "rank::VARCHAR", "printf('%.3f', similarity)", "printf('%.1f', similarity * 100) || '%'", _s(augment.NOTHING)
    sentences_of = f"array_to_string(list_transform(list_filter(list_transform(string_split({squeezed('content', True)}, '.'), lambda s: {squeezed('s', True)}), lambda s: s <> ''), lambda s: s || '.'), ' ')"
    rates, limits = (["연\\s*[0-9]+\\.?[0-9]*\\s*%", "[0-9]+\\.?[0-9]*\\s*%", "금리.*?[0-9]+\\.?[0-9]*"], ["[0-9]+억\\s*원?", "[0-9]+천만\\s*원?", "[0-9]+백만\\s*원?", "[0-9]+만\\s*원?", "[0-9]+%\\s*이내"])
    every = lambda ps: "flatten([" + ", ".join(f"regexp_extract_all(content, '{p}')" for p in ps) + "])"
    line = lambda title, c: f"CASE WHEN len({c}) > 0 THEN '**{title}:** ' || array_to_string(({_distinct(c)})[1:5], ', ') || chr(10) || chr(10) ELSE '' END"
    ask, head = "'질문: ' || query || chr(10) || chr(10)", "'# 질문' || chr(10) || query || chr(10) || chr(10)"
    return f"""WITH {candidates}, q AS (SELECT item_id AS query_id, query FROM items),
top AS (SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM cand QUALIFY rank <= {augment.MOST}),
w AS (SELECT query_id, rank, similarity, 'doc ' || doc_id AS source, text AS content, list_filter(string_split_regex(text, '[{WHITE}]+'), lambda x: x <> '') AS ws FROM top JOIN documents USING (doc_id)),
t AS (SELECT *, sum(len(ws)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM w), o AS (SELECT *, sum(CASE WHEN total > {augment.BUDGET} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS over, {augment.BUDGET} - (total - len(ws)) AS room FROM t),
kept AS (SELECT query_id, rank, similarity, source, CASE WHEN over = 0 THEN content ELSE array_to_string(ws[1:room], ' ') || '...' END AS content FROM o WHERE over = 0 OR (over = 1 AND room > {augment.WORTH})),
clean AS (SELECT * REPLACE ({squeezed('content')} AS content) FROM kept),
facts AS (SELECT query_id, flatten(list({every(rates)} ORDER BY rank)) AS rates, flatten(list({every(limits)} ORDER BY rank)) AS limits, bool_or(len({every(rates + limits)}) > 0 OR regexp_matches(content, '자격|조건|대상|요건|기준|신청|방법|절차|접수')) AS any_fact FROM clean GROUP BY query_id),
l AS ({_lay('general', f"chr(10) || '[문서 ' || {no} || '] (유사도: ' || {three} || ')' || chr(10) || content || chr(10) || chr(10) || '출처: ' || source || chr(10)", f"{ask} || '관련 문서들:' || chr(10)", nothing=nothing)}
UNION ALL {_lay('qa', f"{no} || '. (유사도: ' || {three} || ') ' || content || chr(10) || chr(10)", "'다음 질문에 답하기 위해 관련 문서들을 검색했습니다:' || chr(10) || chr(10) || " + ask + " || '참고 문서들:' || chr(10)", "'위 문서들을 참고하여 질문에 정확하고 상세하게 답변해주세요.'", rows="kept WHERE rank <= 3")}
UNION ALL {_lay('summarization', f"'[문서 ' || {no} || ']' || chr(10) || content || chr(10) || chr(10)", "'다음 주제에 대한 문서들을 요약해주세요:' || chr(10) || chr(10) || '주제: ' || query || chr(10) || chr(10) || '문서들:' || chr(10)", "'위 문서들을 종합하여 핵심 내용을 요약해주세요.'")}
UNION ALL {_lay('prompt', f"'[문서 ' || {no} || '] (관련도: ' || {three} || ')' || chr(10) || content || chr(10) || chr(10)", f"{_s(augment.SYSTEM)} || chr(10) || chr(10) || '사용자 ' || {ask} || '참고 문서들:' || chr(10)", "'위 문서들을 참고하여 질문에 답변해주세요.'")}
UNION ALL {_lay('markdown', f"'### 문서 ' || {no} || ' (관련도: ' || {three} || ')' || chr(10) || '**출처:** ' || source || chr(10) || chr(10) || {sentences_of} || chr(10) || chr(10)", f"{head} || '## 관련 문서' || chr(10)")}
UNION ALL SELECT 'json', query_id, '{{"query":' || to_json(query) || ',"documents":[' || coalesce(body, '') || ']}}' FROM q LEFT JOIN (SELECT query_id, string_agg('{{"id":' || rank || ',"content":' || to_json(content) || ',"similarity":' || similarity || ',"metadata":{{"source":' || to_json(source) || '}}}}', ',' ORDER BY rank) AS body FROM kept GROUP BY query_id) USING (query_id)
UNION ALL {_lay('conversational', f"'정보 ' || {no} || ' (신뢰도: ' || {percent} || '):' || chr(10) || content || chr(10) || chr(10)", f"{ask} || '관련 정보를 찾았습니다:' || chr(10) || chr(10)", "'이 정보들을 바탕으로 답변드리겠습니다.'")}
UNION ALL {_lay('structured', f"'DOCUMENT ' || {no} || ':' || chr(10) || 'Content: ' || content || chr(10) || 'Relevance Score: ' || printf('%.4f', similarity) || chr(10) || 'Metadata: {{''source'': ''' || source || '''}}' || chr(10) || repeat('-', 30) || chr(10)", "'QUERY: ' || query || chr(10) || chr(10) || 'DOCUMENTS:' || chr(10) || repeat('=', 50) || chr(10)")}
UNION ALL SELECT layout, query_id, context || CASE WHEN any_fact THEN '# 핵심 정보 요약' || chr(10) || chr(10) || {line('금리', 'rates')} || {line('대출한도', 'limits')} ELSE '' END FROM (
  {_lay('policy', f"'## 참고 문서 ' || {no} || ' (관련도: ' || {percent} || ')' || chr(10) || '**출처:** ' || source || chr(10) || chr(10) || '**내용:**' || chr(10) || content || chr(10) || chr(10) || '---' || chr(10) || chr(10)", f"{head} || '# 관련 정책 정보' || chr(10) || chr(10)", rows="clean")}) LEFT JOIN facts USING (query_id)
UNION ALL {_lay('enhanced', f"CASE WHEN similarity > 0.85 THEN '[🔥 매우 관련성 높음] ' WHEN similarity > 0.75 THEN '[✓ 관련성 높음] ' ELSE '' END || '문서 ' || {no} || ' (출처: ' || source || ')' || chr(10) || {squeezed('content')} || chr(10) || chr(10)", f"{ask} || '다음 문서들을 참고하여 질문에 답변해주세요:' || chr(10) || chr(10)", _s(augment.CAUTIONS))})
SELECT layout, query_id, CAST(length(context) AS INTEGER) AS n_chars, md5(context) AS context_md5, context FROM l"""
