"""SQL twins of the text columns, for DuckDB: relational, without look-around or possessive quantifiers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from idiomark.functions import html as h
from idiomark.functions.lexicon import Lexicon
from idiomark.functions.text import ADDRESS, GLUE, HEAD, NARROW, NL, TAIL, WIDE, WORD, WS, L
from idiomark.functions.tokens import RUN, SENTENCE_END

SIZE = HEAD + TAIL


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(c: str, forms: Iterable[str]) -> str:
    forms = sorted(forms)
    return f"{c} IN ({', '.join(map(lit, forms))})" if forms else "false"


def values(rows: list[tuple], names: str) -> str:
    """A relation of literal rows."""

    def one(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else lit(v)

    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS _v({names}))"


def _ends(t: str, k: int) -> str:
    return f"CASE WHEN length({t}) > {k * SIZE} THEN left({t}, {k * HEAD}) || chr(10) || right({t}, {k * TAIL}) ELSE {t} END"


def stripped(c: str) -> str:
    """Addresses blanked, white space collapsed."""
    chunks = f"list_filter(regexp_split_to_array(l, {lit(f'[{WS}]+')}), lambda x: x <> '')"
    line = f"array_to_string(list_transform({chunks}, lambda x: CASE WHEN regexp_matches(x, {lit(ADDRESS)}) THEN '' ELSE x END), ' ')"
    lines = rf"regexp_split_to_array(regexp_replace({c}, {lit(f'(?:{NL})' + chr(92) + 'z')}, ''), {lit(NL)})"
    return f"array_to_string(list_transform({lines}, lambda l: {line}), chr(10))"


def window(src: str, p: str = "") -> str:
    """CTEs from the relation src(id, t): {p}cut(id, c) before addresses go, {p}win(id, w) after."""
    elide = f"'([{WORD}])[''’]([{WORD}])', '\\1\\2', 'g'"
    return f"""
{p}a AS (SELECT id, t, nfc_normalize({_ends("t", NARROW)}) AS n FROM {src}),
{p}b AS (SELECT id, CASE WHEN length(t) > {NARROW * SIZE} AND length(n) < {SIZE} THEN nfc_normalize({_ends("t", WIDE)}) ELSE n END AS c FROM {p}a),
{p}c AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(c, '\\\\[nrt]', ' ', 'g'), {elide}), {elide}) AS c FROM {p}b),
{p}cut AS (SELECT id, CASE WHEN length(c) > {SIZE} THEN regexp_replace(left(c, {HEAD}), '[{L}]+\\z', '') || chr(10) || regexp_replace(right(c, {TAIL}), '\\A[{L}]+', '') ELSE c END AS c FROM {p}c),
{p}win AS (SELECT id, {stripped("c")} AS w FROM {p}cut)"""


def tokens(p: str = "") -> str:
    """CTE {p}tok(id, i, w, k, si) from {p}win."""
    return rf"""
{p}run AS (SELECT id, unnest(regexp_extract_all(w, '[{RUN}]+')) AS r, unnest(regexp_extract_all(w, '([^{RUN}]*)([{RUN}]+)', 1)) AS g, unnest(range(len(regexp_extract_all(w, '[{RUN}]+')))) AS i FROM {p}win),
{p}tok AS (SELECT id, i, r AS w, lower(r) AS k, CASE WHEN regexp_matches(g, {lit(SENTENCE_END + "[" + WS + "]*" + chr(92) + "z")}) OR (i = 0 AND regexp_matches(g, '\A[{WS}]*\z')) THEN 2
  WHEN regexp_matches(g, '[\n\r][{WS}]*\z') THEN 1 ELSE 0 END AS si FROM {p}run WHERE NOT regexp_matches(r, '[{GLUE}]'))"""


def decisive(k: str, lex: Lexicon) -> str:
    out = among(k, lex.decisive | lex.compounds)
    if lex.suffix:
        out += rf" OR (regexp_matches({k}, '^.{{2,}}{lex.suffix}\z')"
        out += rf" AND NOT regexp_matches({k}, '({'|'.join(lex.not_suffixed)}).{{0,5}}\z'))" if lex.not_suffixed else ")"
    return f"({out})"


def verdict(src: str, lex: Lexicon, p: str = "") -> str:
    """CTEs up to {p}verdict(id, fire, certain, matched, grounded) over src(id, t)."""
    return f"""{window(src, p)},{tokens(p)},
{p}mk AS (SELECT * FROM (SELECT id, k, si, {decisive("k", lex)} AS dec, {among("k", lex.supporting)} AS sup, (NOT ({among("k", lex.cased)}) OR w = k) AS free,
  w = upper(left(w, 1)) || lower(substr(w, 2)) AS cap FROM {p}tok) WHERE dec OR sup),
{p}gr AS (SELECT id, bool_or(free) AS grounded FROM {p}mk GROUP BY id),
{p}ac AS (SELECT {p}mk.*, grounded FROM {p}mk JOIN {p}gr USING (id) WHERE free OR (cap AND (si = 2 OR (si = 1 AND grounded)))),
{p}v AS (SELECT id, bool_or(dec) AS certain, count(DISTINCT k) FILTER (WHERE sup) AS n, bool_and({among("k", lex.weak)}) FILTER (WHERE sup) AS weak,
  list_sort(list(DISTINCT k) FILTER (WHERE sup)) AS matched FROM {p}ac GROUP BY id),
{p}verdict AS (SELECT s.id, coalesce(certain OR n >= CASE WHEN coalesce(weak, true) THEN {lex.least_weak} ELSE {lex.least_supporting} END, false) AS fire, coalesce(certain, false) AS certain,
  coalesce(array_to_string(matched, ' '), '') AS matched, coalesce(g.grounded, false) AS grounded
  FROM {src} s LEFT JOIN {p}v v USING (id) LEFT JOIN {p}gr g USING (id))"""


def words(t: str) -> str:
    return f"regexp_extract_all(lower(nfc_normalize({t})), '[{L}]+')"


def decomposed(t: str) -> str:
    """NFD of texts whose composed letters are Latin ones up to U+017F; the database has no function for it."""
    for c in map(chr, range(0xC0, 0x180)):
        if (d := unicodedata.normalize("NFD", c)) != c:
            t = f"replace({t}, {lit(c)}, {lit(d)})"
    return t


def clean(c: str, entities: dict[str, str]) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', '', 'g')"
    for name, char in entities.items():
        out = f"replace({out}, {lit(name)}, {lit(char)})"
    return rf"regexp_replace(regexp_replace({out}, '[{WS}]+', ' ', 'g'), '\A +| +\z', '', 'g')"


def _tidy(c: str) -> str:
    return f"trim({c}, {lit(h.EDGES)})"


def _folded(c: str) -> str:
    return f"trim(replace(lower(nfc_normalize({c})), 'ß', 'ss'))"


def _spelling(c: str) -> str:
    """Whether a fragment can be a spelling."""
    labels = "|".join(sorted(h.QUALIFIERS))
    return rf"(len(regexp_extract_all({c}, '\S+')) <= {h.MOST_WORDS} AND NOT regexp_matches(regexp_replace({c}, '^(\s*(?i:{labels})\.\s+)+', ''), {lit('[!?' + chr(34) + '«»„“”]|[.]' + chr(92) + 's+[a-zäöü]')}))"


def lookup(entries: str, pages: str, most_pages: int = h.MOST_PAGES, limit: int = 5) -> str:
    """CTEs from entries and pages (query, page_no, html): hd with heads, status, shown. Parts and their words are rows here."""
    labels, back = sorted(h.QUALIFIERS), sorted(h.TRAILING)
    label = lambda w, forms: f"trim(lower({w}), '.,:') IN ({', '.join(map(lit, forms))})"
    no_form = ", ".join(map(lit, sorted(h.NO_FORMS | h.QUALIFIERS)))
    notes = "|".join(h.NOTES)
    line = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '^[^:]*:', ''), '\([^)]*\)', '', 'g'), '(?s)\s+[-–—]\s+.*$', ''), '(?s)\s(?:{notes})\s*:.*$', '')"
    closing = lit('[!?"«»„“”]' + chr(92) + "s*$")
    short = rf"\(([^)\s,;]{{0,{h.MOST_OPTIONAL}}})\)"
    bare = rf"regexp_replace(regexp_replace(word, '{short}', chr(1) || '\1' || chr(2), 'g'), '\([^)]*\)', '', 'g')"
    return rf"""
en AS (SELECT row_number() OVER () AS e, * FROM ({entries})),
own AS (SELECT e, unnest([replace(replace(b, chr(1), ''), chr(2), ''), regexp_replace(b, '\x01[^\x02]*\x02', '', 'g')]) AS v FROM (SELECT e, {bare} AS b FROM en)),
lines AS (SELECT e, alt AS l FROM en UNION ALL SELECT e, ': ' || pos FROM en),
raw AS (SELECT e, unnest(regexp_split_to_array({line}, '[,;/]')) AS r FROM lines WHERE l <> ''),
sp AS (SELECT e, {_tidy("r")} AS p FROM raw WHERE NOT regexp_matches(r, {closing}) AND {_tidy("r")} <> '' AND {_spelling(_tidy("r"))}),
part AS (SELECT e, p, true AS back FROM sp UNION ALL SELECT e, unnest(regexp_split_to_array(v, '[,;/]')), false FROM own WHERE trim(v) <> ''),
w AS (SELECT *, row_number() OVER () AS k, regexp_extract_all(p, '\S+') AS w FROM part),
word AS (SELECT k, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
front AS (SELECT k, least(n - 1, min(CASE WHEN NOT {label("x", labels)} THEN i - 1 ELSE n END)) AS f FROM word GROUP BY k, n),
behind AS (SELECT k, least(n - f - 1, min(CASE WHEN i > f AND NOT {label("x", back)} THEN n - i ELSE n END)) AS b FROM word JOIN front USING (k) GROUP BY k, n, f),
peeled AS (SELECT e, array_to_string(w[j + 1:], ' ') AS form, back FROM w JOIN front USING (k), range(1, 99) AS r(j) WHERE j <= f
  UNION ALL SELECT e, array_to_string(w[f + 1:len(w) - j], ' '), back FROM w JOIN front USING (k) JOIN behind USING (k), range(1, 99) AS r(j) WHERE back AND j <= b
  UNION ALL SELECT e, w[len(w)], back FROM w JOIN front USING (k) WHERE NOT back AND len(w) - f > 1 AND len(list_filter(w[f + 1:len(w) - 1], lambda x: NOT ends_with(x, '.'))) = 0),
derived AS (SELECT e, lower(p) AS form FROM sp
  UNION ALL SELECT e, lower({_tidy("split_part(p, ':', -1)")}) FROM sp WHERE contains(p, ':') AND {_tidy("split_part(p, ':', -1)")} <> '' AND {_spelling(_tidy("split_part(p, ':', -1)"))}
  UNION ALL SELECT e, CASE WHEN back THEN lower(form) ELSE form END FROM peeled
  UNION ALL SELECT e, unnest(regexp_split_to_array(v, '[,;/]')) FROM own WHERE regexp_matches(v, '[,;/]')),
fit AS (SELECT e, {_tidy("form")} AS form FROM derived),
head AS (SELECT e, {_folded(_tidy("v"))} AS form FROM own WHERE {_tidy("v")} <> ''
  UNION SELECT e, {_folded("form")} FROM fit WHERE form <> '' AND NOT contains(form, '.') AND {_folded("form")} NOT IN ({no_form})
    AND len(list_filter(regexp_extract_all(form, '\S+'), lambda x: {_folded("x")} IN ({no_form}))) = 0),
hd AS (SELECT en.*, h.heads FROM en LEFT JOIN (SELECT e, list_sort(list(DISTINCT form)) AS heads FROM head GROUP BY e) h USING (e)),
pg AS (SELECT query, page_no, html, {_folded("CASE WHEN " + _tidy("query") + " <> '' THEN " + _tidy("query") + " ELSE query END")} AS needle FROM {pages}),
tot AS (SELECT query, coalesce(max(CASE WHEN page_no = 1 THEN coalesce(list_max(list_transform(regexp_extract_all(html, 'page=(\d+)', 1), lambda x: x::BIGINT)), 1) END), 1) AS total, bool_or(html IS NULL) AS broken FROM pg GROUP BY query),
hit AS (SELECT hd.*, list_contains(coalesce(heads, []), needle) AS exact FROM hd JOIN pg USING (query, page_no) JOIN tot USING (query) WHERE page_no <= least(total, {most_pages})),
stop AS (SELECT query, min(page_no) AS stop FROM hit WHERE exact GROUP BY query),
seen AS (SELECT hit.*, stop FROM hit LEFT JOIN stop USING (query) WHERE stop IS NULL OR page_no <= stop),
status AS (SELECT query, CASE WHEN stop IS NOT NULL THEN 'EXACT' WHEN total <= {most_pages} AND NOT broken THEN 'ABSENT' ELSE 'UNKNOWN' END AS status, coalesce(stop, least(total, {most_pages}))::INT AS pages_read,
  stop IS NOT NULL OR (total <= {most_pages} AND NOT broken) AS exhausted, (SELECT count(*) FROM seen WHERE seen.query = tot.query AND exact) AS n_exact, (SELECT count(*) FROM seen WHERE seen.query = tot.query AND NOT exact) AS n_related
  FROM tot LEFT JOIN stop USING (query)),
shown AS (SELECT query, page_no::INT AS page_no, position::INT AS position, word, exact, url FROM (SELECT *, row_number() OVER (PARTITION BY query, exact ORDER BY page_no, position) AS o FROM seen) WHERE exact OR o <= {limit})"""
