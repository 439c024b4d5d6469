"""DuckDB SQL for the registered queries, written from the formulas and independent of the Spark plans."""

from __future__ import annotations

from ..config import VocabularyConfig
from ..functions import patterns as P


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _words(t: str) -> str:
    return rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '')"


def _strip(t: str) -> str:
    return f"trim({t}, E' \\n\\t\\r')"


def _count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


_TOKENS = r"regexp_extract_all(lower(c), '[\p{L}\p{N}_]+')"
RAW = "SELECT doc_id, coalesce(text, '') AS c, source FROM documents"
MARKERS = "(?i)" + P.STRUCTURED_MARKERS

def _round(v: str, k: int) -> str:
    """Halves away from zero in decimal, as the number prints."""
    return f"round(({v})::DOUBLE::DECIMAL(20, 9), {k})::DOUBLE"


#: Every curation metric of the whole texts.
SCORED = rf"""
raw AS ({RAW}),
tok AS (SELECT *, {_words("c")} AS w, {_TOKENS} AS t FROM raw),
cnt AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(w, lambda x: lower(x))) AS x FROM tok) GROUP BY 1, 2),
ent AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) AS k FROM cnt GROUP BY 1),
m AS (
  SELECT doc_id, c, w, t, len(w) AS n,
    least(coalesce(k, 0) / greatest(len(w), 1) * 1.5, 1.0) AS l,
    CASE WHEN coalesce(k, 0) > 1 THEN least(h / log2(k) * 1.2, 1.0) ELSE 0.3 END AS i,
    least(len(list_filter(t, lambda x: x IN ({_in(P.TECHNICAL_TERMS)}))) / greatest(len(w), 1) * 100.0, 1.0) AS te,
    least({_count("c", MARKERS)} / 5.0, 1.0) AS s,
    least(len(list_filter(t, lambda x: x IN ({_in(P.DOMAIN_INDICATORS)}))) / greatest(len(w), 1) * 50.0, 1.0) AS d,
    0.3 AS r
  FROM tok LEFT JOIN ent USING (doc_id)),
scored AS (
  SELECT doc_id, c, w, t, n,
    CASE WHEN n > 0 THEN {_round("l", 4)} ELSE 0 END AS lexical_diversity, CASE WHEN n > 0 THEN {_round("i", 4)} ELSE 0 END AS information_density,
    CASE WHEN n > 0 THEN {_round("te", 4)} ELSE 0 END AS technical_density, CASE WHEN n > 0 THEN {_round("s", 4)} ELSE 0 END AS structural_quality,
    CASE WHEN n > 0 THEN {_round("d", 4)} ELSE 0 END AS domain_relevance, CASE WHEN n > 0 THEN {_round("r", 4)} ELSE 0 END AS content_richness,
    CASE WHEN n > 0 THEN {_round("greatest(l::DOUBLE * 0.15::DOUBLE + i::DOUBLE * 0.20::DOUBLE + te::DOUBLE * 0.15::DOUBLE + s::DOUBLE * 0.15::DOUBLE + d::DOUBLE * 0.15::DOUBLE + r::DOUBLE * 0.20::DOUBLE, 0.2::DOUBLE)", 4)} ELSE 0 END AS overall_score
  FROM m),
graded AS (
  SELECT *, CASE WHEN overall_score >= 0.9 THEN 'A+' WHEN overall_score >= 0.8 THEN 'A' WHEN overall_score >= 0.7 THEN 'B+' WHEN overall_score >= 0.6 THEN 'B'
    WHEN overall_score >= 0.5 THEN 'C+' WHEN overall_score >= 0.4 THEN 'C' ELSE 'D' END AS quality_grade FROM scored)
"""

#: Normalised contents and the first stage's reasons.
NORMAL = rf"""
raw AS ({RAW}),
page AS (SELECT doc_id, source, CASE WHEN length({_strip("c")}) >= 10 THEN {_strip("c")} ELSE '' END AS o FROM raw),
lines AS (
  SELECT doc_id, source, o, list_transform(string_split(regexp_replace(regexp_replace(o, '\n\s*\n\s*\n+', E'\n\n', 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: {_strip("x")}) AS l FROM page),
norm AS (
  SELECT doc_id, source, o, {_strip(r"array_to_string(list_filter(l, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$') AND (length(x) > 5 OR regexp_matches(x, '\p{L}'))), chr(10))")} AS c FROM lines),
gate AS (
  SELECT doc_id, source, o, c, len({_words("c")}) AS n,
    len(list_filter(list_transform(string_split(c, '.'), lambda x: {_strip("x")}), lambda x: length(x) >= 5)) AS pieces,
    {_count("c", P.SYMBOL_RUN)} + len(list_filter({_TOKENS}, lambda x: regexp_full_match(x, '{P.CONSONANT_WORD}'))) AS gib
  FROM norm),
reasons AS (
  SELECT *, CASE WHEN o = '' OR n < 50 THEN 'No extractable content' WHEN pieces < 2 THEN 'Too few sentences: ' || pieces || ' < 2'
    WHEN gib > n * 0.2 THEN 'Too much gibberish: ' || gib || ' matches' END AS reason FROM gate)
"""

_SYLL = (
    "CASE WHEN z = '' THEN 0 ELSE greatest(len(regexp_extract_all(z, '[aeiouy]+')) - CASE WHEN z LIKE '%e' AND len(regexp_extract_all(z, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1) END"
)
#: DuckDB's \\b knows ASCII only: letters of the fixture's languages beyond it become a plain one.
_PLAIN = "regexp_replace(c, '[À-ÿŒœ]', 'a', 'g')"
EXTRACTION = rf"""
raw AS ({RAW}),
tok AS (SELECT doc_id, c, {_words("c")} AS w, list_filter(list_transform(regexp_split_to_array(c, '[.!?]+'), lambda x: {_strip("x")}), lambda x: x <> '') AS s FROM raw),
flat AS (SELECT doc_id, unnest(w) AS x FROM tok),
syl AS (SELECT doc_id, sum({_SYLL}) AS syll FROM (SELECT doc_id, regexp_replace(lower(x), '^[.,!?;:]+|[.,!?;:]+$', '', 'g') AS z FROM flat) GROUP BY 1),
ent AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) AS k FROM (SELECT doc_id, lower(x), count(*) AS n FROM flat GROUP BY 1, 2) GROUP BY 1),
x AS (
  SELECT doc_id, len(w) AS n, len(s) AS ns, coalesce(k, 0) AS k, h, coalesce(syll, 0) AS syll,
    list_sum(list_transform(s, lambda q: len({_words("q")}))) AS ws, list_sum(list_transform(s, lambda q: {_count("q", "[,;:]")})) AS marks,
    {_count(_PLAIN, r"\b[0-9]+\.?[0-9]*\b")} + {_count(_PLAIN, r"\b[A-Z]{2,}\b")} AS tech
  FROM tok LEFT JOIN syl USING (doc_id) LEFT JOIN ent USING (doc_id)),
y AS (
  SELECT doc_id, n, ns, least(k / greatest(n, 1)::DOUBLE, 1.0) AS l,
    CASE WHEN ns = 0 OR n = 0 THEN 0 WHEN syll > 0 THEN greatest(0, least((206.835::DOUBLE - 1.015::DOUBLE * n / greatest(ns, 1) - 84.6::DOUBLE * syll / greatest(n, 1)) / 100.0, 1.0)) ELSE 0.5 END AS e,
    CASE WHEN k > 1 THEN h / log2(k) ELSE 0 END AS i,
    CASE WHEN ns = 0 THEN 0 ELSE (least(ws / ns::DOUBLE / 20.0, 1.0) + least(marks / ns::DOUBLE / 3.0, 1.0)) / 2.0 END AS st,
    CASE WHEN n > 0 THEN least(tech / n::DOUBLE * 2.0, 0.4) ELSE 0 END AS r
  FROM x),
ext AS (
  SELECT doc_id, n AS word_count, ns AS sentence_count, CASE WHEN n = 0 THEN 0 ELSE {_round("l", 3)} END AS lexical_diversity, CASE WHEN n = 0 THEN 0 ELSE {_round("e", 3)} END AS readability,
    CASE WHEN n = 0 THEN 0 ELSE {_round("st", 3)} END AS structural_complexity, CASE WHEN n = 0 THEN 0 ELSE {_round("r", 3)} END AS richness,
    CASE WHEN n = 0 THEN 0 ELSE least(greatest(l::DOUBLE * 0.25::DOUBLE + e::DOUBLE * 0.25::DOUBLE + i::DOUBLE * 0.20::DOUBLE + st::DOUBLE * 0.15::DOUBLE + r::DOUBLE * 0.15::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END AS q
  FROM y)
"""
KEY = rf"""lower(regexp_replace(regexp_replace(c, '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'))"""
SHINGLES = rf"""
raw AS ({RAW}), tok AS (SELECT doc_id, {_TOKENS} AS t FROM raw),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i : i + 4], ' '))) AS s FROM tok WHERE len(t) >= 5)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1)
"""


#: The first document of each shingle set.
EQUAL = f"{SHINGLES}, eq AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS f FROM (SELECT doc_id, list_sort(list(s)) AS k FROM sh GROUP BY 1))"


def _fuzzy(threshold: float) -> str:
    return f"""WITH {EQUAL}, sr AS (SELECT sh.* FROM sh JOIN eq USING (doc_id) WHERE doc_id = f),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS m FROM sr a JOIN sr b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT i, j, {_round('m / (x.n + y.n - m)::DOUBLE', 6)} AS similarity FROM p JOIN sz x ON x.doc_id = i JOIN sz y ON y.doc_id = j WHERE m / (x.n + y.n - m)::DOUBLE >= {threshold}"""


GRAMS = rf"""
raw AS ({RAW}),
tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(c), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_in(P.STOP_WORDS)})) AS t FROM raw),
gr AS (
  SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: array_to_string(t[i : i + 1], ' '))) AS term FROM tok
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i : i + 2], ' '))) FROM tok WHERE len(t) > 2),
tf AS (SELECT doc_id, term, count(*) AS tf FROM gr GROUP BY 1, 2),
stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1 HAVING count(*) <= 0.95 * (SELECT count(*) FROM documents))
"""


def _redacted() -> str:
    t = "c"
    for name, pattern in P.PII:
        t = f"regexp_replace({t}, '{pattern}', '[{name}]', 'g')"
    return t


def _category() -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(c), '{'|'.join(ws)}') THEN '{name}'" for name, ws in P.CATEGORY_WORDS)
    return f"CASE {cases} ELSE 'general' END"


VOC = rf"""
voc AS (
  SELECT w AS word, count(*) AS frequency FROM (
    SELECT unnest(list_transform({_words("translate(coalesce(text, ''), ',.();:', '      ')")}, lambda x: lower(x))) AS w FROM documents)
  WHERE length(w) >= 3 AND regexp_matches(w, '\p{{L}}') GROUP BY 1),
base AS (
  SELECT DISTINCT w AS token FROM (SELECT unnest(list_transform({_words("translate(coalesce(text, ''), ',.();:', '      ')")}, lambda x: lower(x))) AS w FROM benchmark)
  WHERE length(w) >= 3 AND regexp_matches(w, '\p{{L}}'))
"""
COUNTS = rf"cnt AS (SELECT doc_id, length(c) AS nc, len(regexp_extract_all(c, '\p{{L}}+|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]+')) AS n FROM ({RAW}) WHERE c <> '')"
RESP = rf"resp AS (SELECT *, len({_words('text')}) AS wc, turn * 0.37::DOUBLE AS sec FROM conversations)"


def _cells(sep: str, least: int) -> str:
    return f"CASE WHEN len(string_split(x, {sep})) >= {least} THEN list_filter(list_transform(string_split(x, {sep}), lambda q: {_strip('q')}), lambda q: q <> '') END"


def _two(e: str) -> str:
    return f"CASE WHEN len({e}) >= 2 THEN {e} END"


_ROW = f"coalesce({_two(_cells('chr(9)', 2))}, {_two(_cells(chr(39) + '|' + chr(39), 2))}, {_two(_cells(chr(39) + '  ' + chr(39), 3))}, {_two(_cells(chr(39) + '   ' + chr(39), 2))})"


def _html() -> str:
    t = "html"
    for tag in ("script", "style", "head"):
        t = rf"regexp_replace({t}, '(?is)<{tag}\b.*?</{tag}\s*>', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)</(p|div|h[1-6]|li|ul|ol|table|tr|section|article|blockquote|pre|title)\s*>|<br\s*/?>', E'\n\n', 'g')"
    t = f"regexp_replace({t}, '(?s)<[^>]*>', '', 'g')"
    for name, mark in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("amp", "&")):
        t = f"replace({t}, '&{name};', '{mark}')"
    blocks = rf"list_filter(list_transform(string_split({t}, E'\n\n'), lambda b: {_strip(chr(114) + 'egexp_replace(b, ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}), lambda b: b <> '')"
    return rf"array_to_string({blocks}, E'\n\n')"


#: Scores of what the first stage leaves, and those that pass the second, with the exact level's key.
EARLY = f"""{NORMAL},
{SCORED.replace(f"raw AS ({RAW})", "sraw AS (SELECT doc_id, c, source FROM reasons WHERE reason IS NULL)").replace("FROM raw", "FROM sraw")},
good AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY sha256({_strip(KEY)})) AS f FROM scored WHERE overall_score >= 0.25)"""


def _greedy(p: str) -> str:
    """{p}g: what the visit of the pairs {p}q (i, j, sim, qi, qj) in order removes; its state is the list of what has gone."""
    gone = f"(list_contains(r.gone, o.i) OR list_contains(r.gone, o.j))"
    return f"""
{p}o AS (SELECT *, row_number() OVER (ORDER BY i, j) AS k FROM {p}q),
{p}r(k, gone, hit) AS (
  SELECT 0::BIGINT, []::BIGINT[], false
  UNION ALL SELECT o.k, CASE WHEN {gone} THEN r.gone ELSE list_append(r.gone, CASE WHEN qi >= qj THEN o.j ELSE o.i END) END, NOT {gone} FROM {p}r r JOIN {p}o o ON o.k = r.k + 1),
{p}g AS (
  SELECT i, j, sim, CASE WHEN qi >= qj THEN j ELSE i END AS removed, CASE WHEN qi >= qj THEN i ELSE j END AS kept, qi >= qj AS logged
  FROM {p}r JOIN {p}o USING (k) WHERE hit)"""


#: fg: what the shingle level removes of fb (doc_id, c, q).
FUZZY = rf"""
ft AS (SELECT doc_id, {_TOKENS} AS t FROM fb),
fsh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i : i + 4], ' '))) AS s FROM ft WHERE len(t) >= 5)),
fsz AS (SELECT doc_id, count(*) AS n FROM fsh GROUP BY 1),
fm AS (SELECT x.doc_id AS i, y.doc_id AS j, count(*) AS m FROM fsh x JOIN fsh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
fp AS (
  SELECT i, j, m / (x.n + y.n - m)::DOUBLE AS sim FROM fm JOIN fsz x ON x.doc_id = i JOIN fsz y ON y.doc_id = j WHERE m / (x.n + y.n - m)::DOUBLE >= 0.85
  UNION ALL SELECT x.doc_id, y.doc_id, 1.0 FROM ft x JOIN ft y ON x.doc_id < y.doc_id WHERE len(x.t) < 5 AND len(y.t) < 5),
fq AS (SELECT i, j, sim, x.q AS qi, y.q AS qj FROM fp JOIN fb x ON x.doc_id = i JOIN fb y ON y.doc_id = j),{_greedy("f")}"""
#: sg: what the term level removes of sb (doc_id, c, q).
SEMANTIC = rf"""
stk AS (SELECT doc_id, list_filter(regexp_extract_all(lower(c), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_in(P.STOP_WORDS)})) AS t FROM sb),
sgr AS (
  SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: array_to_string(t[i : i + 1], ' '))) AS term FROM stk
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i : i + 2], ' '))) FROM stk WHERE len(t) > 2),
stf AS (SELECT doc_id, term, count(*) AS tf FROM sgr GROUP BY 1, 2),
svo AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM stf GROUP BY 1 HAVING count(*) <= 0.95 * (SELECT count(*) FROM sb) ORDER BY cf DESC, term LIMIT 5000),
sw AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM sb)) / (1.0 + df)) + 1.0) AS x FROM stf JOIN svo USING (term)),
su AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM sw),
sp AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.x * b.x) AS sim FROM su a JOIN su b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.x * b.x) >= 0.8),
sq AS (SELECT i, j, sim, x.q AS qi, y.q AS qj FROM sp JOIN sb x ON x.doc_id = i JOIN sb y ON y.doc_id = j),{_greedy("s")}"""
#: The raw texts that the similarity levels get by themselves: scored, of more than four words, the first of each exact key.
KEEPERS = f"""{SCORED}, kb AS (
  SELECT doc_id, c, overall_score AS q FROM scored WHERE n > 4 AND doc_id IN (SELECT min(doc_id) FROM raw GROUP BY sha256({_strip(KEY)})))"""
#: All levels in turn.
LEVELS = f"""{EARLY},
fb AS (SELECT doc_id, c, overall_score AS q FROM scored JOIN good USING (doc_id) WHERE doc_id = f),{FUZZY},
sb AS (SELECT * FROM fb WHERE doc_id NOT IN (SELECT removed FROM fg)),{SEMANTIC},
left_over AS (SELECT doc_id FROM sb WHERE doc_id NOT IN (SELECT removed FROM sg))"""
_STAGES = """s AS (
  SELECT 'input' AS stage, count(*) AS documents FROM raw UNION ALL SELECT 'prepared', count(*) FROM reasons WHERE reason IS NULL UNION ALL SELECT 'quality', count(*) FROM good
  UNION ALL SELECT 'exact', count(*) FROM fb UNION ALL SELECT 'fuzzy', count(*) FROM sb UNION ALL SELECT 'semantic', count(*) FROM left_over)"""
_REJECTED = """r AS (
  SELECT 'Stage 1 - Preparation' AS stage, reason FROM reasons WHERE reason IS NOT NULL
  UNION ALL SELECT 'Stage 2 - Quality', 'Low quality score: ' || format('{:.3f}', overall_score) || ' < 0.25' FROM scored WHERE overall_score < 0.25
  UNION ALL SELECT 'Stage 3 - Exact Dedup', 'Exact duplicate' FROM good WHERE doc_id <> f
  UNION ALL SELECT 'Stage 3 - Fuzzy Dedup', 'Fuzzy duplicate' FROM fg UNION ALL SELECT 'Stage 3 - Semantic Dedup', 'Semantic duplicate' FROM sg)"""
_REMOVALS = f"SELECT i, j, {_round('sim', 6)} AS similarity, removed, kept, logged"
_LISTED = f"len(list_filter(t, lambda x: x IN ({_in(P.TECHNICAL_TERMS)}))) + len(list_filter(t, lambda x: x IN ({_in(P.DOMAIN_INDICATORS)})))"
#: What is kept up to there, with its domain and boosted score.
def _curated(before: str, kept: str) -> str:
    return f"""{before},
rel AS (SELECT doc_id, c, n, overall_score, CASE WHEN n > 0 THEN least(greatest(({_LISTED}) / n::DOUBLE * 20.0, 0.1), 1.0) ELSE 0.2 END AS r FROM scored),
cur AS (SELECT doc_id, c, n, {_category()} AS domain, CASE WHEN r >= 0.1 THEN least(overall_score * 1.2::DOUBLE, 1.0) ELSE overall_score END AS score FROM rel WHERE doc_id IN ({kept}))"""


CURATED = _curated(EARLY, "SELECT f FROM good")
FULL = _curated(LEVELS, "SELECT doc_id FROM left_over")


def _distributions(curated: str, pairs: str) -> str:
    return f"""{curated}
SELECT 'domain' AS kind, domain AS name, count(*) AS n FROM cur GROUP BY 2 UNION ALL SELECT 'grade', quality_grade, count(*) FROM scored JOIN graded USING (doc_id) WHERE scored.overall_score >= 0.25 GROUP BY 2
UNION ALL {pairs} UNION ALL SELECT 'quality', 'mean', round(avg(score) * 10000)::BIGINT FROM cur"""


_PAIRS_BY_LEVEL = """SELECT 'exact' AS type, count(*) AS removed FROM good WHERE doc_id <> f HAVING count(*) > 0 UNION ALL SELECT 'fuzzy', count(*) FROM fg WHERE logged HAVING count(*) > 0
UNION ALL SELECT 'semantic', count(*) FROM sg WHERE logged HAVING count(*) > 0"""


def _rows(names: str, *rows: str) -> str:
    """Results of hand-made rows, as worked out by hand."""
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({names})"


ORACLES = {
    "doc_word_frequency": f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(list_transform({_words('c')}, lambda x: lower(x))) AS word FROM ({RAW})) GROUP BY 1, 2",
    "early_retention": f"""WITH {EARLY}, s AS (
  SELECT 'input' AS stage, count(*) AS documents FROM raw UNION ALL SELECT 'prepared', count(*) FROM reasons WHERE reason IS NULL
  UNION ALL SELECT 'quality', count(*) FROM good UNION ALL SELECT 'exact', count(DISTINCT f) FROM good)
SELECT stage, documents, round(documents / (SELECT count(*) FROM raw), 6) AS retention FROM s""",
    "early_rejections": f"""WITH {EARLY}, r AS (
  SELECT 'Stage 1 - Preparation' AS stage, reason, CASE WHEN reason = 'No extractable content' THEN 0 ELSE n END AS n FROM reasons WHERE reason IS NOT NULL
  UNION ALL SELECT 'Stage 2 - Quality', 'Low quality score: ' || format('{{:.3f}}', overall_score) || ' < 0.25', n FROM scored WHERE overall_score < 0.25
  UNION ALL SELECT 'Stage 3 - Exact Dedup', 'Exact duplicate', n FROM good WHERE doc_id <> f)
SELECT stage, reason, count(*) AS documents, sum(n)::BIGINT AS words FROM r GROUP BY 1, 2""",
    "early_metadata": "WITH " + _distributions(CURATED, "SELECT 'pairs', 'exact', count(*) FROM good WHERE doc_id <> f HAVING count(*) > 0"),
    "fuzzy_dedup": f"WITH RECURSIVE {KEEPERS}, fb AS (SELECT * FROM kb),{FUZZY} {_REMOVALS} FROM fg",
    "semantic_dedup": f"WITH RECURSIVE {KEEPERS}, sb AS (SELECT * FROM kb),{SEMANTIC} {_REMOVALS} FROM sg",
    "multi_level_dedup": f"WITH RECURSIVE {LEVELS} {_PAIRS_BY_LEVEL}",
    "stage_retention": f"WITH RECURSIVE {LEVELS}, {_STAGES} SELECT stage, documents, round(documents / (SELECT count(*) FROM raw), 6) AS retention FROM s",
    "rejection_reasons": f"WITH RECURSIVE {LEVELS}, {_REJECTED} SELECT stage, reason, count(*) AS documents FROM r GROUP BY 1, 2",
    "curation_statistics": rf"""WITH RECURSIVE {LEVELS}, {_REJECTED}, {_STAGES}
SELECT 'stages' AS kind, stage AS name, documents AS n FROM s UNION ALL SELECT 'rejections', stage, count(*) FROM r GROUP BY 2
UNION ALL SELECT 'reasons', regexp_replace(reason, '[0-9].*$|:.*$', ''), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'pairs', type, removed FROM ({_PAIRS_BY_LEVEL})""",
    "curation_metadata": "WITH RECURSIVE " + _distributions(FULL, f"SELECT 'pairs', type, removed FROM ({_PAIRS_BY_LEVEL})"),
    "curated_dataset": f"""WITH RECURSIVE {FULL} SELECT doc_id, left(md5(c), 12) AS id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS training_rank, md5({_redacted()}) AS text_md5,
  {_redacted()} <> c AS pii_removed, {_round('score', 6)} AS quality_score, quality_grade, domain AS domain_category, cur.n::INT AS word_count, left(sha256({_strip(KEY)}), 12) AS content_hash FROM cur JOIN (SELECT doc_id, quality_grade FROM graded) USING (doc_id)""",
    "curation_report": f"""WITH RECURSIVE {FULL}, k AS (SELECT (SELECT count(*) FROM raw) AS a, (SELECT count(*) FROM left_over) AS b)
SELECT a AS input_documents, b AS final_documents, round(b / a, 6) AS retention_rate, (SELECT round(avg(score), 4) FROM cur) AS mean_quality, (SELECT sum(({_redacted()} <> c)::INT)::BIGINT FROM cur) AS documents_with_personal_data FROM k""",
    "early_training_rows": f"""WITH {CURATED} SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS training_rank, md5({_redacted()}) AS text_md5, {_redacted()} <> c AS pii_removed, domain AS domain_category FROM cur""",
    "early_reason_files": f"WITH {NORMAL} SELECT reason, count(*) AS files, sum(doc_id)::BIGINT AS ids FROM reasons WHERE reason IS NOT NULL GROUP BY 1",
    "extraction_statistics": f"""WITH {EXTRACTION} SELECT count(*) AS files, sum((word_count > 0)::INT)::BIGINT AS successful, round(avg(q), 4) AS mean_quality, round(min(q), 4) AS least_quality,
  round(max(q), 4) AS largest_quality, {', '.join(f"sum((least(floor(q * 10), 9) = {i})::INT)::BIGINT AS t{i}" for i in range(10))} FROM ext""",
    "model_comparison": """WITH s AS (SELECT event_type AS model, count(*) AS n, avg(value) AS l FROM events GROUP BY 1), p AS (SELECT * FROM (VALUES (0, 'view'), (1, 'click'), (2, 'none')) AS t(place, model))
SELECT place, p.model, n IS NOT NULL AS exists, n, coalesce(round(l, 4), 'inf'::DOUBLE) AS avg_loss, round(((SELECT l FROM s WHERE model = 'view') - l) / (SELECT l FROM s WHERE model = 'view') * 100, 4) AS improvement_pct FROM p LEFT JOIN s USING (model)""",
    "embedding_report": """WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2),
n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1), k AS (SELECT count(*) AS k FROM n)
SELECT k AS new_tokens, k AS initialised, k AS zeroed, true AS passed, (row_number() OVER (ORDER BY label) - 1)::INT AS place, label AS token, round(norm, 4) AS norm FROM n, k ORDER BY label LIMIT 3""",
    "manual_embedding_fallback": """WITH f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64))::INT AS place FROM embeddings)
SELECT 'none' AS token, false AS initialised, place, round(avg(x), 5) AS x FROM f GROUP BY place UNION ALL SELECT 'pieces', true, place, round(avg(x), 5) FROM f WHERE vec_id IN (0, 1) GROUP BY place""",
    "markdown_table_cases": _rows("doc_id, table_no, content, row_count", "(1, 1, E'| a | b |\\n|---|---|\\n| 1 | 2 |', 2)", "(1, 2, E'| c |\\n| 3 |', 1)", "(3, 1, '| x |', 0)"),
    "html_table_cases": _rows("page_id, tables", "(1, 2)", "(2, 0)", "(3, 0)"),
    "pii_cases": _rows("id, redacted, pii_removed", "(1, 'call [PHONE] or [PHONE]', true)", "(2, 'id [SSN].', true)", "(3, '[CREDIT_CARD]', true)", "(4, '[IP_ADDRESS] [EMAIL]', true)", "(5, 'nothing 12-34', false)"),
    "near_image_cases": _rows("id, images", """(1, '[{"width":100,"height":50},{"width":105,"height":50}]')""", "(2, '[]')", """(3, '[{"width":11,"height":11},{"width":300,"height":11}]')"""),
    "page_summary_cases": _rows("id, summary", "(1, '1,3')", "(2, 'P1-6')", "(3, '')", "(4, '5,6,7,8,9')"),
    "unique_table_cases": _rows("doc_id, page, place", "(1, 1, 0)", "(1, 2, 2)", "(1, 1, 3)", "(2, 1, 4)"),
    "added_table_cases": _rows("doc_id, page, strategy, place, rows, cols", "(1, 1, 1, 1, 3, 2)", "(1, 1, 3, 0, 5, 5)", "(1, 2, 1, 0, 2, 2)", "(1, 3, 9, 0, 7, 7)"),
    "block_table_cases": _rows("doc_id, block, flat, rows, cols, confidence", "(1, 0, E'a | b\\nc | d', 2, 2, 'medium')", "(2, 0, E'x | y\\n1 | 2\\n3 | 4', 3, 2, 'medium')"),
    "grid_box_cases": _rows("page_id, rows, cols, bbox", "(1, 1, 1, '0,0,9,10')"),
    "unicode_cases": _rows("id, normalised", "(1, 'fine 12 line')", "(2, 'softhyphen andspace')", "(3, 'plain text here')"),
    "element_cases": _rows("filename, text, tables, element_count", "('a', E'Head\\n\\n1 2', '<table>1 2</table>', 3)", "('b', 'only', 'only', 1)"),
    "page_key_cases": _rows("ord, reason, middle, last", "(1, NULL, 398, 416)", "(2, 'Processing error: page key is no number: zero', 0, 0)"),
    "document_file_cases": _rows(
        "file, extraction_method, extraction_success, has_error, text", "('a.txt', 'text', true, false, E'plain text\nof two lines')", "('b.html', 'html', true, false, 'A & B')",
        "('c.docx', 'docx', true, false, E'First\nSecond part')", "('d.docx', 'failed', false, true, NULL)", "('e.pdf', 'pdf', true, false, 'one page')", "('f.pdf', 'failed', false, true, NULL)",
    ),
    "extracted_json_cases": _rows("file_path, pages, total_pages", "('a/good.pdf', 1, 1)"),
    "json_lines_cases": _rows("kind, text", "('all', 'one')", "('all', 'two')", "('all', 'three')", "('all', 'last')", "('first five', 'one')", "('first five', 'two')", "('first five', 'three')"),
    "gzip_training_rows": "SELECT kind, kind = 'gz' AS gz, (SELECT count(*) FROM documents) AS rows FROM (VALUES ('gz'), ('plain')) AS t(kind)",
    "table_append_cases": _rows("ord, original_content", "(1, E'The first page.\n\nThe third page.\n\n[TABLE_1]\na\n1 | 2\n\n[TABLE_3]\na\n1 | 2')"),
    "shown_pair_cases": "SELECT 10 AS ten, 0 AS eleven",
    "embedding_resize": """WITH f AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, unnest(range(64))::INT AS place FROM embeddings WHERE vec_id < 100)
SELECT id, place, round(x, 5) AS x FROM f UNION ALL SELECT 100 + k, place, round(avg(x), 5) FROM f, (VALUES (0), (1)) AS t(k) GROUP BY 1, 2""",
    "training_steps": f"SELECT n, n < 100 AS small, 16 AS effective_batch, n // 16 AS steps_per_epoch, n // 16 * 3 AS total_steps, 0 AS warnings_0, 2 AS warnings_1 FROM (SELECT count(*) AS n FROM ({RAW}) WHERE {_strip('c')} <> '')",
    "model_registry_cases": _rows("model, info, chosen", "('a', 'a (enabled): org/a', true)", "('b', 'b (disabled): org/b', false)", "('c', 'c (enabled): org/c', false)"),
    "configuration_cases": _rows("words, quality, sentences", "(10, 0.75::DOUBLE, 2)"),
    "training_lines_read_back": f"SELECT md5(c) AS text_md5, length(c) AS n_chars, count(*) AS rows FROM ({RAW}) WHERE c <> '' GROUP BY 1, 2",
    "limited_lines_read_back": "SELECT md5(text) AS text_md5 FROM (SELECT CASE WHEN item_id % 7 = 0 THEN '' ELSE text END AS text, item_id FROM benchmark ORDER BY item_id LIMIT 30) WHERE text <> ''",
    "document_files_read_back": f"SELECT doc_id::VARCHAR || '.pdf' AS filename, md5(c) AS text_md5 FROM ({RAW})",
    "vocabulary_files_read_back": f"WITH {VOC} SELECT word, frequency FROM voc WHERE frequency >= 200",
    "doc_word_stats": f"SELECT doc_id, len({_words('c')}) AS n_words, length(c) AS n_chars, len(list_distinct(list_transform({_words('c')}, lambda x: lower(x)))) AS n_distinct FROM ({RAW})",
    "doc_ids_md5": f"SELECT doc_id, left(md5(c), 12) AS id, left(sha256(c), 12) AS sha_id FROM ({RAW})",
    "normalize_lines": f"WITH {NORMAL.replace('length(' + _strip('c') + ') >= 10', 'true')} SELECT doc_id, md5(c) AS content_md5 FROM norm",
    "comparison_key": f"SELECT doc_id, md5({_strip(KEY)}) AS key_md5 FROM ({RAW})",
    "prepared_documents": f"WITH {NORMAL} SELECT doc_id, left(md5(c), 12) AS id, n AS word_count, length(c) AS char_count, md5(o) AS original_md5 FROM gate",
    "sentence_gate": f"SELECT doc_id, len(list_filter(list_transform(string_split(c, '.'), lambda x: {_strip('x')}), lambda x: length(x) >= 5)) AS pieces, len(list_filter(list_transform(string_split(c, '.'), lambda x: {_strip('x')}), lambda x: length(x) >= 5)) >= 2 AS passes FROM ({RAW})",
    "gibberish_gate": f"SELECT doc_id, g AS matches, g <= n * 0.2 AS passes FROM (SELECT doc_id, len({_words('c')}) AS n, {_count('c', P.SYMBOL_RUN)} + len(list_filter({_TOKENS}, lambda x: regexp_full_match(x, '{P.CONSONANT_WORD}'))) AS g FROM ({RAW}))",
    "stage1_gate_reasons": f"WITH {NORMAL} SELECT reason, count(*) AS documents FROM reasons WHERE reason IS NOT NULL GROUP BY 1",
    "rejection_files": f"WITH {NORMAL} SELECT doc_id, doc_id::VARCHAR AS filename, reason FROM reasons WHERE reason IS NOT NULL",
    **{k: f"WITH {SCORED} SELECT doc_id, {k} FROM scored" for k in ("lexical_diversity", "information_density", "technical_density", "structural_quality", "domain_relevance", "content_richness")},
    "quality_score": f"WITH {SCORED} SELECT doc_id, overall_score, quality_grade FROM graded",
    "quality_grades": f"WITH {SCORED} SELECT quality_grade, count(*) AS documents, round(avg(overall_score), 4) AS mean_score FROM graded GROUP BY 1",
    "quality_gate": f"WITH {SCORED} SELECT count(*) AS kept, round(min(overall_score), 4) AS least_score FROM scored WHERE overall_score >= 0.25",
    "extraction_quality": f"WITH {EXTRACTION} SELECT doc_id, {_round('q', 4)} AS overall_quality, CASE WHEN q >= 0.9 THEN 'A+' WHEN q >= 0.8 THEN 'A' WHEN q >= 0.7 THEN 'B+' WHEN q >= 0.6 THEN 'B' WHEN q >= 0.5 THEN 'C+' WHEN q >= 0.4 THEN 'C' WHEN q >= 0.3 THEN 'D' ELSE 'F' END AS extraction_grade, word_count, sentence_count FROM ext",
    "readability": f"WITH {EXTRACTION} SELECT doc_id, readability FROM ext",
    "structural_complexity": f"WITH {EXTRACTION} SELECT doc_id, structural_complexity FROM ext",
    "extraction_richness": f"WITH {EXTRACTION} SELECT doc_id, richness FROM ext",
    "extraction_run_stats": f"WITH {EXTRACTION} SELECT count(*) AS documents, sum((word_count > 0)::INT) AS successes, round(avg(q), 4) AS avg_quality, round(min(q), 4) AS min_quality, round(max(q), 4) AS max_quality, round(avg(lexical_diversity), 4) AS avg_lexical, round(avg(readability), 4) AS avg_readability FROM ext",
    "exact_dedup": f"SELECT min(doc_id) AS doc_id, left(h, 12) AS content_hash FROM (SELECT doc_id, sha256({_strip(KEY)}) AS h FROM ({RAW})) GROUP BY h",
    "exact_dup_pairs": f"SELECT 'exact' AS type, doc_id AS removed, f AS kept FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256({_strip(KEY)})) AS f FROM ({RAW})) WHERE f <> doc_id",
    "shingle_counts": f"WITH {SHINGLES} SELECT doc_id, coalesce(n, 0) AS n_shingles FROM raw LEFT JOIN sz USING (doc_id)",
    "fuzzy_pairs": _fuzzy(0.85),
    "fuzzy_pairs_half": _fuzzy(0.5),
    "fuzzy_members": f"WITH {EQUAL} SELECT doc_id, f AS representative FROM eq",
    "tfidf_top_terms": f"WITH {GRAMS} SELECT term, df, cf FROM stats ORDER BY cf DESC, term LIMIT 50",
    "semantic_pairs": f"""WITH {GRAMS}, v AS (SELECT term, df FROM stats ORDER BY cf DESC, term LIMIT 5000),
w AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0) AS x FROM tf JOIN v USING (term)),
u AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM w WHERE doc_id IN (SELECT min(doc_id) FROM raw GROUP BY c))
SELECT a.doc_id AS i, b.doc_id AS j, {_round('sum(a.x * b.x)', 6)} AS similarity FROM u a JOIN u b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.x * b.x) >= 0.8""",
    "domain_category": f"SELECT {_category()} AS domain_category, count(*) AS documents FROM ({RAW}) GROUP BY 1",
    "domain_boost": f"""WITH {SCORED}, r AS (SELECT doc_id, overall_score, CASE WHEN n > 0 THEN least(greatest((len(list_filter(t, lambda x: x IN ({_in(P.TECHNICAL_TERMS)}))) + len(list_filter(t, lambda x: x IN ({_in(P.DOMAIN_INDICATORS)})))) / n::DOUBLE * 20.0, 0.1), 1.0) ELSE 0.2 END AS rel FROM scored)
SELECT doc_id, {_round('rel', 4)} AS relevance, {_round('CASE WHEN rel >= 0.1 THEN least(overall_score * 1.2::DOUBLE, 1.0) ELSE overall_score END', 6)} AS boosted_score FROM r""",
    "pii_redact": f"SELECT doc_id, md5({_redacted()}) AS redacted_md5, {_redacted()} <> c AS pii_removed FROM ({RAW})",
    "pii_counts": "SELECT " + ", ".join(f"sum({_count('c', p)})::BIGINT AS {n.lower()}" for n, p in P.PII) + f" FROM ({RAW})",
    "training_rank": f"WITH {SCORED} SELECT doc_id, row_number() OVER (ORDER BY overall_score DESC, doc_id)::INT AS training_rank FROM scored",
    "curated_top_k": f"WITH {SCORED} SELECT doc_id, overall_score FROM scored ORDER BY overall_score DESC, doc_id LIMIT 20",
    "word_frequency": f"WITH {VOC} SELECT word, frequency FROM voc",
    "vocabulary_counters": f"WITH {VOC} SELECT sum(frequency)::BIGINT AS total_words, count(*) AS unique_words, sum((frequency >= 200)::INT)::BIGINT AS frequent_words FROM voc",
    "vocab_anti_join": f"WITH {VOC} SELECT word, frequency FROM voc WHERE frequency >= 20 AND word NOT IN (SELECT token FROM base)",
    "vocab_semi_join": f"WITH {VOC} SELECT word, frequency FROM voc WHERE frequency >= 20 AND word IN (SELECT token FROM base)",
    "vocab_growth": f"""WITH {VOC}, b AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM base)
SELECT token, id FROM b UNION ALL SELECT word, (SELECT count(*) FROM b) + row_number() OVER (ORDER BY frequency DESC, word) - 1 FROM voc WHERE frequency >= 200 AND word NOT IN (SELECT token FROM base)""",
    "vocab_candidates": f"""WITH RECURSIVE {VOC}, word0 AS (SELECT word, frequency FROM voc WHERE frequency >= 200 AND word NOT IN (SELECT token FROM base)),
cut(word, frequency, rest, pieces) AS (
  SELECT word, frequency, word, []::VARCHAR[] FROM word0
  UNION ALL
  SELECT word, frequency, substr(rest, k + 1), list_append(pieces, substr(rest, 1, k)) FROM (
    SELECT word, frequency, rest, pieces, coalesce((SELECT max(length(token)) FROM base WHERE length(token) <= 16 AND starts_with(rest, token)), 1) AS k FROM cut WHERE rest <> ''))
SELECT word, frequency, len(pieces) AS split_count, pieces AS base_tokens FROM cut WHERE rest = '' AND len(pieces) > 1""",
    "manual_tokens": f"WITH {VOC} SELECT token, token IN (SELECT word FROM voc) AS present FROM (SELECT unnest([{_in(VocabularyConfig().manual_tokens)}]) AS token)",
    "token_counts": f"WITH {COUNTS} SELECT doc_id, n AS n_tokens FROM cnt",
    "token_stats": f"WITH {COUNTS} SELECT count(*) AS num_documents, sum(n)::BIGINT AS total_tokens, round(avg(n), 4) AS mean_tokens, round(median(n), 4) AS median_tokens, min(n) AS min_tokens, max(n) AS max_tokens, round(stddev_pop(n), 4) AS std_tokens, round(avg(nc), 4) AS mean_chars, round(sum(nc) / sum(n), 4) AS chars_per_token FROM cnt",
    "token_percentiles": f"WITH {COUNTS} SELECT p AS percentile, round(v, 4) AS value FROM (SELECT unnest([10, 25, 50, 75, 90, 95, 99]) AS p, unnest((SELECT quantile_cont(n, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) FROM cnt)) AS v)",
    "batch_estimates": f"WITH {COUNTS}, t AS (SELECT sum(n)::BIGINT AS total FROM cnt) SELECT s AS sequence_length, total // s AS sequences, b AS batch_size, (total // s) // b AS batches FROM t, (SELECT unnest([512, 1024, 2048, 4096]) AS s), (SELECT unnest([1, 2, 4, 8]) AS b)",
    "fixed_length_encode": f"SELECT doc_id, array_to_string(list_resize(list_transform({_words('c')}, lambda x: length(x)), 64, 0), ',') AS ids FROM ({RAW})",
    "training_tokens": f"SELECT count(*) AS rows, count(*) * 4096 AS approximate_tokens FROM ({RAW}) WHERE {_strip('c')} <> ''",
    "embedding_mean_by_group": "SELECT label, place, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS place FROM embeddings) GROUP BY 1, 2",
    "embedding_norm_check": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) < 1e-6 AS is_zero FROM embeddings",
    "embedding_zero_rows": "SELECT count(*) AS rows, sum((label = 0 OR list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) < 1e-12)::INT)::BIGINT AS zero_rows FROM embeddings",
    "embedding_init_report": "SELECT n AS new_tokens, n AS initialised, true AS inputs_ok, n AS zeroed, true AS outputs_ok, true AS passed FROM (SELECT count(DISTINCT label) AS n FROM embeddings)",
    "train_val_split": f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || '-42'), doc_id) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'validation' END AS split FROM ({RAW}) WHERE {_strip('c')} <> ''",
    "dataset_read_back": f"SELECT split, count(*) AS rows, sum(length(c))::BIGINT AS n_chars FROM (SELECT c, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || '-42'), doc_id) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'validation' END AS split FROM ({RAW}) WHERE {_strip('c')} <> '') GROUP BY 1",
    "loss_monitor": "SELECT event_id, first_value(value) OVER w AS initial_loss, min(value) OVER w AS best_loss, value > 10 AS is_spike, value > 3 * first_value(value) OVER w AS is_explosion FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
    "early_stopping": """WITH a AS (SELECT *, min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
b AS (SELECT *, best IS NULL OR best - value > 0.01 AS improved FROM a),
c AS (SELECT *, sum(improved::INT) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM b),
d AS (SELECT *, sum((NOT improved)::INT) OVER (PARTITION BY event_type, run ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS waited FROM c)
SELECT event_id, improved, waited, min(CASE WHEN waited >= 8 THEN event_id END) OVER (PARTITION BY event_type) AS stop_step FROM d""",
    "model_loss_summary": "SELECT event_type AS model, count(*) AS n, round(avg(value / 100), 6) AS avg_loss, round(exp(avg(value / 100)), 4) AS perplexity FROM events GROUP BY 1",
    "improvement_verdict": """WITH s AS (SELECT event_type AS model, avg(value) AS l FROM events GROUP BY 1), p AS (SELECT model, ((SELECT l FROM s WHERE model = 'view') - l) / (SELECT l FROM s WHERE model = 'view') * 100 AS p FROM s WHERE model <> 'view')
SELECT model, round(p, 4) AS improvement_pct, CASE WHEN p > 0 THEN 'improved' WHEN p < -5 THEN 'degraded' ELSE 'marginal' END AS verdict, abs(p) < 5 AS init_ok FROM p""",
    "loss_boxplot": "SELECT event_type AS model, round(min(value), 4) AS low, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, round(max(value), 4) AS high FROM events GROUP BY 1",
    "response_metrics": f"WITH {RESP} SELECT conv_id, turn, role, wc AS word_count, round(sec, 3) AS generation_time, CASE WHEN sec > 0 THEN round(wc / sec, 2) ELSE 0 END AS words_per_second FROM resp",
    "response_speed_up": f"""WITH {RESP}, r AS (SELECT conv_id, role, CASE WHEN sec > 0 THEN round(wc / sec, 2) ELSE 0 END AS r FROM resp),
s AS (SELECT conv_id, coalesce(round(avg(CASE WHEN role = 'user' THEN r END), 4), 0) AS a, coalesce(round(avg(CASE WHEN role = 'assistant' THEN r END), 4), 0) AS b FROM r GROUP BY 1)
SELECT conv_id, CASE WHEN a >= b THEN 'user' ELSE 'assistant' END AS faster, round(greatest(a, b) / nullif(least(a, b), 0), 3) AS ratio FROM s""",
    "response_table": "SELECT conv_id::VARCHAR AS prompt, max(CASE WHEN role = 'assistant' THEN length(text) END) AS assistant, max(CASE WHEN role = 'system' THEN length(text) END) AS system, max(CASE WHEN role = 'user' THEN length(text) END) AS user FROM conversations GROUP BY conv_id",
    "html_text": f"SELECT page_id, md5({_html()}) AS text_md5 FROM pages",
    "html_tables": "SELECT page_id, len(regexp_extract_all(html, '(?is)<table.*?</table>')) AS tables FROM pages",
    "markdown_tables": f"""WITH l AS (SELECT doc_id, unnest(string_split(c, chr(10))) AS x, unnest(range(len(string_split(c, chr(10))))) AS no FROM ({RAW})),
i AS (SELECT doc_id, no, {_strip("x")} AS x FROM l WHERE {_strip("x")} LIKE '|%' AND {_strip("x")} LIKE '%|'),
r AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run FROM i),
t AS (SELECT doc_id, min(no) AS a, string_agg(x, chr(10) ORDER BY no) AS x, count(*) - 1 AS row_count FROM r GROUP BY doc_id, run)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS table_no, md5(x) AS content_md5, row_count FROM t""",
    "latex_equations": rf"""WITH e AS (SELECT doc_id, list_concat(list_transform(regexp_extract_all(c, '\$([^$]+)\$', 1), lambda x: {{'type': 'inline', 'latex': x}}), list_transform(regexp_extract_all(c, '\$\$([^$]+)\$\$', 1), lambda x: {{'type': 'display', 'latex': x}})) AS e FROM ({RAW})),
u AS (SELECT doc_id, unnest(range(len(e))) AS place, unnest(e) AS e FROM e) SELECT doc_id, place, e.type AS type, md5({_strip("e.latex")}) AS latex_md5 FROM u""",
    "text_pattern_tables": f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(c, chr(10)), lambda x: {_ROW}), lambda r: r IS NOT NULL) AS t, len(string_split(c, chr(10))) AS n FROM ({RAW})),
k AS (SELECT doc_id, list_filter(t, lambda r: abs(len(r) - list_sum(list_transform(t, lambda q: len(q))) / len(t)) <= 1) AS t FROM l WHERE n >= 2 AND len(t) >= 2)
SELECT doc_id, len(t) AS rows, md5(array_to_string(list_transform(t, lambda r: array_to_string(r, ' | ')), chr(10))) AS flat_md5, true AS valid FROM k WHERE len(t) >= 2""",
    "validation_sample": f"SELECT doc_id, length(c) AS n_chars FROM (SELECT * FROM ({RAW}) ORDER BY doc_id LIMIT 100) WHERE length({_strip('c')}) > 50",
    "json_roundtrip": "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, '{\"k\":' || (props::JSON ->> 'k') || '}' AS json FROM events",
    "optional_predicates": """SELECT doc_id, coalesce(list_bool_or(list_transform(range(1, 11), lambda k: length(t) % k = 0 AND length(t) // k >= 6 AND t = repeat(left(t, k::INT), (length(t) // k)::INT))), false) AND NOT contains(t, chr(10)) AS low_information
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\n$', '') AS t FROM documents)""",
    "optional_predicate_cases": _rows("id, low_information, repetitive", "(1, true, false)", "(2, false, false)", "(3, true, false)", "(4, false, false)", "(5, false, true)", "(6, false, false)", "(7, false, false)"),
    "document_stats": f"SELECT doc_id, len({_words('c')}) AS total_words, 0 AS total_tables, 0 AS total_images, 1 AS total_pages FROM ({RAW})",
    "extraction_success": f"SELECT count(*) AS files, sum(({_strip('c')} <> '')::INT)::BIGINT AS successful, sum(({_strip('c')} = '')::INT)::BIGINT AS failed, count(*) AS elements, 1.0::DOUBLE AS mean_elements, sum(({_strip('c')} <> '')::INT) * 100.0::DOUBLE / count(*) AS success_rate FROM ({RAW})",
    "word_count_range": f"SELECT min(n) AS min, max(n) AS max, sum(n)::BIGINT AS total FROM (SELECT len({_words('c')}) AS n FROM ({RAW}))",
    "pretrain_check": f"WITH {VOC} SELECT (SELECT bool_and(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) >= 1e-6) FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 3)) AS rows_ok, (SELECT count(*) FROM base) = (SELECT count(*) FROM embeddings) AS sizes_ok",
}
