"""The results of the queries as DuckDB SQL over the same tables."""

from __future__ import annotations

# White space as in the text rules; RE2's \s covers five ASCII characters only.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"


def collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def normalized(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def matches(c: str, *tokens: str) -> str:
    return "(" + " AND ".join(f"contains({normalized(c)}, '{token}')" for token in tokens) + ")"


def unescaped(c: str) -> str:
    """The entities that occur in the pages, with or without semicolon, the ampersand last."""
    for entity, character in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = f"regexp_replace({c}, '&{entity};?', '{character}', 'g')"
    return c


def cleaned(c: str) -> str:
    return collapsed(f"regexp_replace({unescaped(c)}, '<[^>]+>', ' ', 'g')")


def joined_text(c: str) -> str:
    """Text nodes of an HTML fragment, each squeezed, joined by a space."""
    nodes = f"regexp_extract_all({c}, '>([^<]+)', 1)"
    return f"trim(array_to_string(list_transform({nodes}, lambda x: {collapsed(unescaped('x'))}), ' '))"


def digest(c: str, name: str = "digest") -> str:
    return f"md5({c}) AS {name}"


RAW = """raw AS (
  SELECT doc_id AS seq, split_part(text, chr(10), 1) AS title, source AS company,
         'https://docs.example/' || md5(text) AS url, text AS description, lang AS location, lang AS source
  FROM documents)"""

ENRICHED = f"""{RAW}, found AS (
  SELECT *, sha256(source || ':' || url) AS id, concat_ws(',',
    CASE WHEN contains(lower(description), 'from') THEN 'From' END,
    CASE WHEN contains(lower(description), 'that') THEN 'That' END,
    CASE WHEN contains(lower(description), 'this') THEN 'This' END,
    CASE WHEN contains(lower(description), 'tion') THEN 'Tion' END,
    CASE WHEN contains(lower(description), 'with') THEN 'With' END) AS skills
  FROM raw), enriched AS (
  SELECT *, CASE WHEN skills <> '' THEN 0.8::DOUBLE
    WHEN regexp_matches(lower(description), '(^|[^\\p{{L}}\\p{{N}}_])(that|with|para|der)($|[^\\p{{L}}\\p{{N}}_])') THEN 0.75::DOUBLE
    ELSE 0.45::DOUBLE END AS confidence,
    strftime(to_timestamp(seq) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS ingested_at
  FROM found)"""

SKILL_COUNTS = f"""{ENRICHED}, mentions AS (
  SELECT unnest(string_split(skills, ',')) AS skill FROM enriched WHERE skills <> ''), top AS (
  SELECT skill, count(*) AS count FROM mentions GROUP BY skill ORDER BY count DESC, skill LIMIT 10)"""

TAGGED = f"""{ENRICHED}, store AS (
  SELECT DISTINCT sha256(lang || ':' || 'https://docs.example/' || md5(text)) AS id
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), tagged AS (
  SELECT *, id IN (SELECT id FROM store) AS known, confidence >= 0.6 AS storable FROM enriched), ranked AS (
  SELECT *, CASE WHEN storable AND NOT known
    THEN row_number() OVER (PARTITION BY id, storable ORDER BY seq) END AS arrival FROM tagged)"""

EVENTS = """e AS (
  SELECT strftime(ts, '%Y%m%d') AS run_id, 'group' || (user_id % 10) AS source, ts, event_id, props,
    CASE event_type WHEN 'view' THEN 'fetched' WHEN 'purchase' THEN 'stored' WHEN 'signup' THEN 'skipped_dedup'
      WHEN 'click' THEN 'skipped_low_confidence' ELSE 'error' END AS outcome
  FROM events)"""

RUNS = f"""{EVENTS}, runs AS (
  SELECT run_id, source, count(*) FILTER (outcome = 'fetched') AS fetched, count(*) FILTER (outcome = 'stored') AS stored,
    count(*) FILTER (outcome = 'skipped_dedup') AS skipped_dedup,
    count(*) FILTER (outcome = 'skipped_low_confidence') AS skipped_low_confidence,
    count(*) FILTER (outcome = 'error') AS error_count, min(ts) AS started_at, max(ts) AS written_at
  FROM e GROUP BY run_id, source), latest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY written_at DESC, source DESC) = 1)"""


def runs_text(relation: str) -> str:
    return f"""SELECT * REPLACE (strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
  strftime(written_at, '%Y-%m-%d %H:%M:%S.%f') AS written_at) FROM {relation}"""


def age(moment: str) -> str:
    seconds = f"greatest(0, floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') // 1000 - epoch_us({moment}) // 1000) / 1000.0))::BIGINT"
    return f"""CASE WHEN {seconds} < 60 THEN 'Just now' WHEN {seconds} < 3600 THEN ({seconds} // 60) || 'm ago'
  WHEN {seconds} < 86400 THEN ({seconds} // 3600) || 'h ago' ELSE ({seconds} // 86400) || 'd ago' END"""


VECTORS = """v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings), parts AS (
  SELECT label, generate_subscripts(x, 1) AS pos, unnest(x) AS value FROM v)"""
LABEL_MEANS = f"""{VECTORS}, sums AS (SELECT label, pos, avg(value) AS value FROM parts GROUP BY label, pos), q AS (
  SELECT label AS question_id, list(value ORDER BY pos) AS m FROM sums GROUP BY label), ranked AS (
  SELECT question_id, id, label, d, row_number() OVER (PARTITION BY question_id ORDER BY round(d, 12), id) AS rank
  FROM (SELECT question_id, id, label, 1 - list_cosine_similarity(x, m) AS d FROM q, v)), best AS (
  SELECT * FROM ranked WHERE rank <= 15)"""
CONTEXTS = f"""{LABEL_MEANS}, contexts AS (
  SELECT question_id,
    string_agg('- vec ' || id || ' at label ' || label || ' (s' || label || ', vector)', chr(10) ORDER BY rank) AS context,
    string_agg('https://vec.example/' || id, ',' ORDER BY rank) AS sources FROM best GROUP BY question_id)"""


def fallback_answer(lines: str) -> str:
    listed = f"list_filter({lines}, lambda l: starts_with(l, '- '))"
    return f"""CASE WHEN len({listed}) = 0 THEN 'No relevant listings were found for the query.'
  ELSE 'Based on the indexed listings: ' || array_to_string(list_transform({listed}[1:5], lambda l: trim(l, '- ')), '; ') END"""


# Pages: an English one carries a posting whose description is the page itself.
PAGE_PARTS = f"""p AS (
  SELECT page_id, url, html, contains(url, '/en/') AS ld, starts_with(url, 'https:') AS recorded,
    {unescaped("regexp_extract(html, '<h1>([^<]+)', 1)")} AS h1,
    {unescaped("regexp_extract(html, '<title>([^<]+)', 1)")} AS page_title,
    'Role of the ' || page_id AS role, {cleaned("html")} AS whole,
    regexp_extract(html, '(?s)<article(>.*)</article>', 1) AS article,
    regexp_extract(html, '(?s)<body(>.*)$', 1) AS body
  FROM pages)"""


def page_view(
    source: str, title: str, company: str, description: str, location: str, posted_at: str,
    matched: str, fetched: str, keep: str, with_cte: str = PAGE_PARTS, shown: str = "md5(description) AS digest",
) -> str:
    return f"""WITH {with_cte}, r AS (
  SELECT page_id AS seq, url, {title} AS title, {company} AS company, {description} AS description,
    {location} AS location, {posted_at} AS posted_at FROM p), m AS (SELECT *, {matched} AS matched FROM r)
SELECT '{source}' AS source, seq, 0 AS pos, title, company, url, {shown}, location,
  coalesce(posted_at, '-') AS posted_at, {fetched} AS fetched, matched FROM m WHERE {keep}"""


# Feeds: one job per line.
LINES = """lines AS (
  SELECT doc_id, lang, source AS src, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
    unnest(string_split(text, chr(10))) AS line FROM documents)"""
BOARD = "upper(src[1]) || src[2:]"
OF_THE = matches("line", "of", "the")


def feed_view(
    source: str, company: str, url: str, description: str, location: str, posted_at: str
) -> str:
    return f"""WITH {LINES}
SELECT '{source}' AS source, doc_id AS seq, pos::INTEGER AS pos, line AS title, {company} AS company, {url} AS url,
  md5({description}) AS digest, {location} AS location, {posted_at} AS posted_at, 1 AS fetched, true AS matched
FROM lines WHERE {OF_THE}"""


def iso(seconds: str) -> str:
    return f"strftime(to_timestamp({seconds}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00')"


def iso_millis(millis: str) -> str:
    return f"""CASE WHEN {millis} % 1000 = 0 THEN {iso(f'{millis} // 1000')}
  ELSE strftime(make_timestamp({millis} * 1000), '%Y-%m-%dT%H:%M:%S.%f+00:00') END"""


LINE_TEXT = collapsed("line")
SITEMAP = """u AS (
  SELECT page_id // 50 AS seq, page_id, url, unnest([0, 1]) AS copy FROM pages), s AS (
  SELECT seq, page_id, copy, url, row_number() OVER (PARTITION BY seq ORDER BY page_id, copy) - 1 AS place FROM u)"""


def encoded(c: str) -> str:
    return f"replace(url_encode({c}), '%20', '+')"


def anchors(pattern: str) -> str:
    """Links of a page with their 0-based position."""
    return f"""a AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '{pattern}', 1)) AS href,
    unnest(regexp_extract_all(html, '{pattern}', 2)) AS label,
    generate_subscripts(regexp_extract_all(html, '{pattern}', 1), 1) - 1 AS place FROM pages)"""


ANCHOR = '<a href="([^"]*)">([^<]*)</a>'

ORACLES: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, md5(n0) AS digest, length(n0) AS n FROM (SELECT doc_id, {normalized('text')} AS n0 FROM documents)",
    "collapse_ws": f"SELECT doc_id, md5(n0) AS digest, length(n0) AS n FROM (SELECT doc_id, {collapsed('text')} AS n0 FROM documents)",
    "embedding_text": f"WITH {RAW} SELECT seq, title || ' ' || company || ' ' || substring(description, 1, 400) AS text FROM raw",
    "embedding_text_whole": f"""WITH {RAW} SELECT seq, md5(text) AS digest, length(text)::INTEGER AS n
FROM (SELECT seq, title || ' ' || company || ' ' || description AS text FROM raw)""",
    "slugify_title": f"WITH {LINES} SELECT doc_id AS seq, pos::INTEGER AS pos, coalesce(nullif(trim(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'job') AS slug FROM lines",
    "board_title": """SELECT p_partkey, array_to_string(list_transform(string_split(
  replace(lower(p_name) || '-' || p_size, '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS company FROM part""",
    "required_fields": f"""SELECT d.doc_id, CASE WHEN {collapsed("split_part(text, '.', 1)")} = '' THEN 'title'
  WHEN quality IS NULL THEN 'company'
  WHEN {collapsed("regexp_extract(text, '(?s)^[^' || chr(10) || ']*' || chr(10) || '(.*)$', 1)")} = '' THEN 'description' END AS reject_reason
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "role_filter": f"""WITH {LINES} SELECT doc_id AS seq, pos::INTEGER AS pos, {matches('line', 'of', 'the')} AS of_the,
  {matches('line', 'tion', 'ther')} AS tion_ther FROM lines""",
    "enrich_documents": f"WITH {ENRICHED} SELECT seq, skills, confidence FROM enriched",
    "enrich_with_model": f"""WITH {ENRICHED} SELECT seq,
  CASE WHEN contains(description, 'token =') THEN skills ELSE 'size ' || (length(description) // 1000) END AS skills,
  CASE WHEN contains(description, 'token =') THEN confidence ELSE least(length(description), 1000) / 1000.0::DOUBLE END AS confidence
FROM enriched""",
    "confidence_kept": f"WITH {ENRICHED} SELECT confidence, count(*) AS n FROM enriched WHERE confidence >= 0.6 GROUP BY confidence",
    "listing_ids_first": f"""WITH {RAW} SELECT sha256('docs:' || url) AS id, url, min(seq) AS seq FROM raw GROUP BY url""",
    "drop_known": f"WITH {TAGGED} SELECT id, seq FROM tagged WHERE NOT known",
    "ingest_outcomes": f"""WITH {TAGGED} SELECT source, count(*) AS fetched, count(*) FILTER (arrival = 1) AS stored,
  count(*) FILTER (known OR arrival > 1) AS skipped_dedup,
  count(*) FILTER (NOT known AND NOT storable) AS skipped_low_confidence FROM ranked GROUP BY source""",
    "ingest_new_listings": f"WITH {TAGGED} SELECT id, seq, source, url, location, confidence, skills FROM ranked WHERE arrival = 1",
    "total_listings": "SELECT count(*) AS total_listings FROM documents",
    "by_source": "SELECT lang AS source, count(*) AS count FROM documents GROUP BY lang",
    "top_skills": f"WITH {SKILL_COUNTS} SELECT * FROM top",
    "stats": f"""WITH {SKILL_COUNTS}, {RUNS} SELECT (SELECT count(*) FROM raw) AS total_listings,
  (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM raw GROUP BY source)) AS by_source,
  (SELECT string_agg(skill || '=' || count, ',' ORDER BY count DESC, skill) FROM top) AS top_skills,
  (SELECT string_agg(concat_ws('/', run_id, source, fetched, stored, skipped_dedup, skipped_low_confidence, error_count), ','
    ORDER BY started_at DESC, run_id, source) FROM (SELECT * FROM latest ORDER BY started_at DESC, run_id, source LIMIT 5)) AS last_runs""",
    "source_coverage": """SELECT lang AS name, 'feed' AS mode, count(*) AS count FROM documents GROUP BY lang
UNION ALL SELECT r_name, 'unused', 0 FROM region""",
    "market_metrics": f"""WITH {SKILL_COUNTS}, {RUNS} SELECT (SELECT count(*) FROM raw) AS total_listings,
  (SELECT count(DISTINCT source) FROM raw) AS source_count, (SELECT least(count(*), 5) FROM latest) AS run_count,
  (SELECT skill FROM top ORDER BY count DESC, skill LIMIT 1) AS leading_skill,
  (SELECT max(count) FROM top) AS leading_count, (SELECT sum(count)::BIGINT FROM top) AS total_mentions""",
    "skill_share": f"""WITH {SKILL_COUNTS} SELECT row_number() OVER (ORDER BY count DESC, skill)::INTEGER AS rank, skill, count,
  round(greatest(4.0::DOUBLE, count::DOUBLE / (SELECT max(count) FROM top) * 100), 6) AS bar_percent
FROM top ORDER BY count DESC, skill LIMIT 8""",
    "search_listings": f"""WITH {ENRICHED} SELECT seq, source FROM enriched
WHERE contains(lower(title || ' ' || company || ' ' || location || CASE WHEN skills = '' THEN '' ELSE ' ' || replace(skills, ',', ' ') END), 'tion')""",
    "search_listings_source": f"""WITH {ENRICHED} SELECT seq, source FROM enriched WHERE source = 'en'
AND contains(lower(title || ' ' || company || ' ' || location || CASE WHEN skills = '' THEN '' ELSE ' ' || replace(skills, ',', ' ') END), 'with')""",
    "listing_card": f"""WITH {ENRICHED} SELECT id, title, url, company, coalesce(nullif(location, 'en'), 'Not specified') AS location,
  CASE WHEN skills = '' THEN 'Not enriched' ELSE array_to_string(string_split(skills, ',')[1:4], ', ') END AS skills,
  source, floor(confidence * 100 + 0.5)::BIGINT AS confidence_percent, confidence >= 0.75 AS is_high FROM enriched""",
    "recent_listings": f"""WITH {ENRICHED} SELECT id, title, company, url, location, source, '-' AS posted_at, skills, confidence, ingested_at
FROM enriched ORDER BY seq DESC LIMIT 12""",
    "listing_preview": f"""WITH {ENRICHED} SELECT id, title, company, url, location, source, '-' AS posted_at, skills, confidence, ingested_at
FROM enriched""",
    "run_counters": f"WITH {RUNS} SELECT * EXCLUDE (started_at, written_at) FROM runs",
    "run_errors": f"WITH {EVENTS} SELECT run_id, source, event_id || ':' || props AS error FROM e WHERE outcome = 'error'",
    "latest_run": f"WITH {RUNS} {runs_text('latest')}",
    "last_runs": f"WITH {RUNS} {runs_text('(SELECT * FROM latest ORDER BY started_at DESC, run_id, source LIMIT 5)')}",
    "run_card": f"""WITH {RUNS} SELECT source, substring(run_id, 1, 8) AS run, fetched, stored, skipped_low_confidence,
  {age('started_at')} AS age FROM runs""",
    "epoch_to_iso": f"""SELECT event_id, CASE event_type WHEN 'view' THEN {iso_millis('(epoch_us(ts) // 1000)')}
  WHEN 'click' THEN {iso('epoch_us(ts) // 1000000')} WHEN 'error' THEN NULL ELSE props END AS posted_at FROM events""",
    "age_label": f"SELECT event_id, CASE WHEN event_type = 'error' THEN props ELSE {age('ts')} END AS age FROM events",
    "similarity_topk": f"""WITH {VECTORS}, sums AS (SELECT pos, avg(value) AS value FROM parts GROUP BY pos), q AS (
  SELECT list(value ORDER BY pos) AS m FROM sums)
SELECT id, round(1 - list_cosine_similarity(x, m), 6) AS distance FROM v, q
ORDER BY round(1 - list_cosine_similarity(x, m), 12), id LIMIT 15""",
    "rank_per_question": f"WITH {LABEL_MEANS} SELECT question_id, id, round(d, 6) AS distance, rank::INTEGER AS rank FROM best",
    "rank_many_questions": f"""WITH {VECTORS}, ranked AS (
  SELECT question_id, id, d, row_number() OVER (PARTITION BY question_id ORDER BY round(d, 12), id) AS rank
  FROM (SELECT q.id AS question_id, v.id, 1 - list_cosine_similarity(v.x, q.x) AS d FROM v q, v WHERE q.id % 10 = 0 AND q.id % 70 <> 0))
SELECT question_id, id, round(d, 6) AS distance, rank::INTEGER AS rank FROM ranked WHERE rank <= 7""",
    "cosine_distance": f"""WITH {LABEL_MEANS} SELECT id AS vec_id, round(1 - list_cosine_similarity(x, m), 6) AS distance
FROM v JOIN q ON v.label = q.question_id""",
    "hash_embed": """WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents), counts AS (
  SELECT doc_id, ('0x' || substring(md5(token), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM tokens GROUP BY 1, 2)
SELECT doc_id, bucket::INTEGER AS bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS weight FROM counts""",
    "retrieve": f"WITH {CONTEXTS} SELECT * FROM contexts",
    "answer_fallback": f"WITH {CONTEXTS} SELECT question_id, {fallback_answer('string_split(context, chr(10))')} AS answer FROM contexts",
    "answer_with_model": f"WITH {CONTEXTS} SELECT question_id, question_id || ': ' || length(context) AS answer FROM contexts",
    "answer_lines": f"""WITH c AS (SELECT doc_id, list_transform(string_split(text, chr(10)),
  lambda l: regexp_replace(l, '^([A-M])', '- \\1')) AS lines FROM documents)
SELECT doc_id, {fallback_answer('lines')} AS answer FROM c""",
    "strip_html": f"SELECT page_id, md5(c) AS digest, length(c) AS n FROM (SELECT page_id, {cleaned('html')} AS c FROM pages)",
    "page_titles": f"WITH {PAGE_PARTS} SELECT page_id, page_title AS title, h1, '' AS h2 FROM p",
    "json_ld_postings": f"""WITH {RAW} SELECT seq, title AS ld_title, company AS ld_company, location AS ld_location,
  seq::VARCHAR AS ld_date, md5(description) AS digest, 2 AS n_blocks FROM raw""",
    "json_ld_shapes": """SELECT doc_id, CASE lang WHEN 'en' THEN source WHEN 'fr' THEN source || ', ' || lang
  WHEN 'de' THEN source ELSE '' END AS location, source AS company, doc_id::VARCHAR AS published FROM documents""",
    "page_cutshort": page_view(
        "cutshort", f"CASE WHEN ld THEN role ELSE rtrim({stripped('h1')}, ',') END",
        "CASE WHEN ld THEN 'Poster' ELSE '' END", "CASE WHEN ld THEN whole ELSE '' END",
        "CASE WHEN ld THEN 'Pune' ELSE 'India' END", "CASE WHEN ld THEN '2024-01-01' END",
        matches("title", "of"), "1", "true",
    ),
    "page_foundit": page_view(
        "foundit", f"CASE WHEN ld THEN role ELSE {stripped('h1')} END",
        "CASE WHEN ld THEN 'Poster' ELSE '' END", "CASE WHEN ld THEN whole ELSE '' END",
        "CASE WHEN ld THEN 'Pune' ELSE 'India' END", "CASE WHEN ld THEN '2024-01-01' END",
        matches("title", "of"), "1", "matched",
    ),
    "page_foundit_demo": page_view(
        "foundit_demo", "CASE WHEN ld THEN role WHEN recorded THEN 'Found of the ' || page_id ELSE '' END",
        "CASE WHEN ld THEN 'Poster' WHEN recorded THEN 'Finder' ELSE '' END",
        "CASE WHEN ld THEN whole WHEN recorded THEN 'Found text' ELSE '' END",
        "CASE WHEN ld THEN 'Pune' ELSE 'India' END",
        "CASE WHEN ld THEN '2024-01-01' WHEN recorded THEN 'yesterday' END", matches("title", "of"), "0", "matched",
    ),
    "page_forage_ai": page_view(
        "forage_ai", f"CASE WHEN ld THEN role ELSE {collapsed('h1')} END", "CASE WHEN ld THEN 'Poster' ELSE 'Forage AI' END",
        f"""CASE WHEN ld THEN whole ELSE trim(array_to_string(list_transform(regexp_extract_all(article, '<p>([^<]+)', 1),
    lambda x: {collapsed(unescaped('x'))}), ' ')) END""",
        "CASE WHEN ld THEN 'Pune' ELSE 'Remote' END", "CASE WHEN ld THEN '2024-01-01' END",
        f"length(description) >= 100 AND {matches('title', 'e')}", "1", "matched",
    ),
    "page_greenhouse_rendered": page_view(
        "greenhouse_playwright", f"CASE WHEN ld THEN role ELSE {collapsed('h1')} END", "CASE WHEN ld THEN 'Poster' ELSE '' END",
        f"""CASE WHEN ld THEN {cleaned("replace(html, '', '')")} ELSE {joined_text("'<i>Goa</i' || article")} END""",
        "CASE WHEN ld THEN 'Pune' ELSE 'Goa' END", "CASE WHEN ld THEN '2024-01-01' END", matches("title", "e"), "1", "matched",
    ),
    "page_indeed": page_view(
        "indeed", "CASE WHEN recorded THEN 'Found of the ' || page_id ELSE '' END", "CASE WHEN recorded THEN 'Finder' ELSE '' END",
        joined_text("article"), "''", "CASE WHEN recorded THEN 'yesterday' END", "true", "0", "matched",
    ),
    "page_ddg": page_view(
        "ddg", f"CASE WHEN recorded THEN 'Found of the ' || page_id ELSE {stripped('page_title')} END",
        "split_part(url, '/', 3)", f"ld_text", "'Unknown'", "NULL", "true", "0", "matched",
    ),
    "attach_search_record": """SELECT page_id, CASE WHEN starts_with(url, 'https:') THEN 'Found of the ' || page_id ELSE '-' END AS title
FROM pages""",
    "feed_arbeitnow": feed_view(
        "arbeitnow", "src", "'https://a'", LINE_TEXT,
        "CASE lang WHEN 'en' THEN 'Berlin' WHEN 'fr' THEN 'Remote' ELSE 'Unknown' END", iso("doc_id * 1000"),
    ),
    "feed_ashby": feed_view(
        "ashby", BOARD, "CASE lang WHEN 'de' THEN 'https://j' ELSE 'https://apply' END", LINE_TEXT,
        "CASE lang WHEN 'en' THEN 'Pune, Remote' WHEN 'de' THEN 'Unknown' ELSE 'Remote' END", "'2024'",
    ),
    "feed_greenhouse": feed_view(
        "greenhouse", f"CASE lang WHEN 'fr' THEN 'Firm' ELSE {BOARD} END", "'https://g'", LINE_TEXT,
        "CASE lang WHEN 'en' THEN 'Pune' ELSE 'Unknown' END", "CASE lang WHEN 'de' THEN 'first' ELSE 'later' END",
    ),
    "feed_himalayas": feed_view(
        "himalayas", "src", "'https://guid'", LINE_TEXT,
        "CASE lang WHEN 'en' THEN 'India, ' || src ELSE 'Remote' END", iso("doc_id + 1700000000"),
    ),
    "feed_lever": feed_view(
        "lever", BOARD, "'https://l'", collapsed("line || ' ' || line || ' end'"),
        "CASE lang WHEN 'en' THEN 'Pune' ELSE 'Unknown' END", iso_millis("(doc_id + 1700000000000)"),
    ),
    "feed_foundit_search": f"""WITH {LINES} SELECT doc_id AS seq, pos::INTEGER AS pos,
  CASE lang WHEN 'de' THEN 'https://feed.example/job/x' ELSE 'https://www.foundit.in/job/' || coalesce(nullif(
    trim(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'job') || '-' || doc_id END AS url,
  line AS title, src AS company, 'new' AS posted_at, md5(line) AS digest
FROM lines WHERE lang <> 'fr' AND {matches('line', 'e')}""",
    "union_sources": f"""WITH {LINES}, kept AS (SELECT doc_id FROM lines WHERE {OF_THE})
SELECT s.source, count(*) AS fetched, count(DISTINCT doc_id) AS n_payloads
FROM kept, (SELECT unnest(['arbeitnow', 'ashby', 'greenhouse', 'himalayas', 'lever']) AS source) s GROUP BY s.source""",
    "himalayas_next": """SELECT 'himalayas' AS source, doc_id AS seq, 2 AS page, 'https://himalayas.app/jobs/api?limit=20&offset=40' AS url
FROM documents WHERE len(string_split(text, chr(10))) > 40""",
    "sitemap_urls": f"""WITH {SITEMAP} SELECT 'any' AS source, seq, place::INTEGER AS pos, url || CASE page_id % 4
  WHEN 0 THEN chr(70000) WHEN 1 THEN chr(128512) || 'A' WHEN 2 THEN '&#x110000;' ELSE '&#65;' END AS url FROM s""",
    "sitemap_distinct": f"""WITH {SITEMAP}, w AS (SELECT seq, url, row_number() OVER (PARTITION BY seq ORDER BY page_id) - 1 AS pos
  FROM s WHERE copy = 0 AND {matches('url', 'en', 'example')}) SELECT 'cutshort' AS source, seq, pos::INTEGER AS pos, url FROM w WHERE pos < 30""",
    "sitemap_repeated": f"""WITH {SITEMAP}, w AS (SELECT seq, url, row_number() OVER (PARTITION BY seq ORDER BY place) - 1 AS pos
  FROM s WHERE {matches('url', 'en', 'example')}) SELECT 'foundit' AS source, seq, pos::INTEGER AS pos, url FROM w WHERE pos < 30""",
    "sitemap_reversed": f"""WITH {SITEMAP}, w AS (SELECT seq, url, row_number() OVER (PARTITION BY seq ORDER BY place DESC) - 1 AS pos
  FROM s WHERE contains(url, '/en/')) SELECT 'forage_ai' AS source, seq, pos::INTEGER AS pos,
  replace(url, '/en/', '/job-opportunities/') AS url FROM w WHERE pos < 30""",
    "page_frontier": f"""WITH {LINES} SELECT doc_id AS seq, pos::INTEGER AS pos, page::INTEGER AS page, (page * 10)::INTEGER AS start,
  'https://in.indeed.com/jobs?q=' || {encoded('line')} || '&l=India&fromage=7&start=' || (page * 10) AS url
FROM lines, (SELECT unnest([0, 1, 2]) AS page) n""",
    "ddg_search": f"""WITH {LINES} SELECT doc_id AS seq, pos::INTEGER AS pos, 'https://duckduckgo.com/html/?q=' ||
  {encoded("'site:linkedin.com/jobs OR site:cutshort.io ' || line")} AS url FROM lines""",
    "foundit_search": f"""WITH {LINES} SELECT doc_id AS seq, pos::INTEGER AS pos, 'https://www.foundit.in/srp/results?query=' ||
  {encoded('line')} || '&locations=India' AS url FROM lines""",
    "arbeitnow_next": """SELECT 'arbeitnow' AS source, doc_id AS seq, (doc_id % 4 + 2)::INTEGER AS page,
  'https://feed.example/' || md5(text) AS url FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 + 1 < 3""",
    "has_embedding": "SELECT vec_id AS id, len(embedding)::INTEGER AS width FROM embeddings WHERE vec_id % 7 <> 0",
    "foundit_pages": f"""SELECT page_id AS seq, n.page::INTEGER AS page, (n.page * (page_id + 5))::INTEGER AS start,
  'https://www.foundit.in/middleware/jobsearch?query=' || {encoded('url')} || '&locations=India&start=' ||
  (n.page * (page_id + 5)) || '&limit=' || (page_id + 5) AS url FROM pages, (SELECT unnest([0, 1, 2]) AS page) n""",
    "board_frontier": """WITH b AS (SELECT c_custkey, unnest(CASE WHEN c_acctbal > 0 THEN [lower(c_mktsegment), c_name]
  ELSE ['airbnb', 'stripe'] END) AS board FROM customer)
SELECT c_custkey, board, 'https://boards-api.greenhouse.io/v1/boards/' || board || '/jobs?content=true' AS url FROM b""",
    "board_link_frontier": f"""WITH {anchors(ANCHOR)}, w AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/]+') || '/jobs' || {unescaped('href')} AS url, min(place) AS place FROM a
  WHERE {matches(unescaped('label'), 'e')} AND starts_with(href, '/') GROUP BY 1, 2)
SELECT 'greenhouse_playwright' AS source, page_id AS seq, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INTEGER AS pos, url FROM w""",
    "result_link_frontier": f"""WITH {anchors(ANCHOR)} SELECT page_id AS seq, place::INTEGER AS pos, {unescaped('href')} AS url,
  {stripped(unescaped('label'))} AS title, 1 AS fetched FROM a""",
    "card_frontier": f"""WITH {LINES} SELECT doc_id AS seq, pos::INTEGER AS pos, 'https://in.indeed.com/v?jk=' || md5(line) AS url,
  {stripped('line')} AS title, src AS company, lang AS location, 1 AS fetched FROM lines""",
}

# Into an empty store: storable rows in order of arrival, and whether an id has one.
_RANKED = f"""{ENRICHED}, ranked AS (SELECT *, confidence >= 0.6 AS storable,
  CASE WHEN confidence >= 0.6 THEN row_number() OVER (PARTITION BY id, confidence >= 0.6 ORDER BY seq) END AS arrival,
  bool_or(confidence >= 0.6) OVER (PARTITION BY id) AS held FROM enriched)"""
_VECTORS = """tokens AS (
  SELECT id, unnest(regexp_extract_all(lower(title || ' ' || company || ' ' || substring(description, 1, 400)), '[a-z0-9]+')) AS token
  FROM ranked WHERE arrival = 1), counts AS (
  SELECT id, ('0x' || substring(md5(token), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM tokens GROUP BY 1, 2), lengths AS (
  SELECT id, sqrt(sum(n * n)) AS length FROM counts GROUP BY id), vectors AS (
  SELECT r.id, md5(string_agg(round(coalesce(c.n / l.length, 0)::FLOAT::DOUBLE * 1000000)::BIGINT, ',' ORDER BY b.bucket)) AS vector
  FROM ranked r CROSS JOIN (SELECT unnest(range(64)) AS bucket) b LEFT JOIN counts c ON r.id = c.id AND b.bucket = c.bucket
  LEFT JOIN lengths l ON r.id = l.id WHERE r.arrival = 1 GROUP BY r.id)"""
ORACLES["ingest_batch"] = ORACLES["ingest_stream"] = ORACLES["ingest_two_streams"] = f"""WITH {_RANKED}, {_VECTORS}
SELECT r.id, source, url, md5(description) AS digest, skills, confidence, location, vector
FROM ranked r JOIN vectors v ON r.id = v.id WHERE arrival = 1"""
ORACLES["ingest_compacted"] = f"""WITH {_RANKED} SELECT source, count(*) AS listings, count(DISTINCT id) AS ids,
  sum(CASE WHEN skills = '' THEN 0 ELSE len(string_split(skills, ',')) END)::BIGINT AS skills,
  (SELECT count(DISTINCT id) FROM ranked WHERE storable) AS all_keys
FROM ranked WHERE arrival = 1 GROUP BY source"""
ORACLES["ingest_run_log"] = f"""WITH {_RANKED} SELECT run_id, source, count(*) AS fetched,
  count(*) FILTER (arrival = 1 AND run_id = 'run1') AS stored,
  count(*) FILTER (CASE WHEN run_id = 'run1' THEN arrival > 1 ELSE held END) AS skipped_dedup,
  count(*) FILTER (NOT CASE WHEN run_id = 'run1' THEN storable ELSE held END) AS skipped_low_confidence
FROM ranked, (SELECT unnest(['run1', 'run2']) AS run_id) r GROUP BY run_id, source"""
ORACLES["ingest_per_source"] = f"""WITH {_RANKED} SELECT 'run' AS run_id, source, count(*) AS fetched,
  count(*) FILTER (arrival = 1) AS stored, count(*) FILTER (arrival > 1) AS skipped_dedup,
  count(*) FILTER (NOT storable) AS skipped_low_confidence, count(*) FILTER (arrival = 1) AS listings
FROM ranked GROUP BY source"""
ORACLES["ingest_errors"] = f"""WITH {RAW}, judged AS (
  SELECT source, length(description) % 2 = 1 AS odd, 'enrich:' || url || '#' || seq || ':odd length' AS error FROM raw), counts AS (
  SELECT source, count(*) FILTER (NOT odd) AS stored, count(*) FILTER (odd) AS error_count FROM judged GROUP BY source)
SELECT 'run' AS run_id, c.source, stored, error_count, j.error
FROM counts c LEFT JOIN (SELECT * FROM judged WHERE odd) j ON j.source = c.source"""
ORACLES["insert_if_absent"] = f"WITH {TAGGED} SELECT DISTINCT id, NOT known AS inserted FROM tagged"

# The page's own text plus, on English pages, the script with its posting: 4000 characters.
_POSTING = """'{"@type":"JobPosting","title":"' || role || '","description":' || to_json(html) ||
  ',"hiringOrganization":{"name":"Poster"},"jobLocation":{"address":{"addressLocality":"Pune"}},"datePosted":"2024-01-01"}'"""
_BODY = joined_text("body")
_DDG_PARTS = f"""{PAGE_PARTS.replace("p AS (", "p0 AS (", 1)}, p AS (SELECT *, substring(trim({_BODY} ||
  CASE WHEN ld THEN ' ' || {collapsed(f"replace({_POSTING}, '</', '<' || chr(92) || '/')")} ELSE '' END), 1, 4000) AS ld_text FROM p0)"""
ORACLES["page_ddg"] = page_view(
    "ddg", f"CASE WHEN recorded THEN 'Found of the ' || page_id ELSE {stripped('page_title')} END",
    "split_part(url, '/', 3)", "ld_text", "'Unknown'", "NULL", "true", "0", "matched", _DDG_PARTS,
)
ORACLES["page_ddg_whole"] = page_view(
    "ddg", f"CASE WHEN recorded THEN 'Found of the ' || page_id ELSE {stripped('page_title')} END",
    "split_part(url, '/', 3)", "ld_text", "'Unknown'", "NULL", "true", "0", "matched", _DDG_PARTS.replace(", 1, 4000)", ", 1)"),
)


def _counted(*view: str, **named: str) -> str:
    return f"""SELECT source, sum(fetched) AS fetched, count(*) FILTER (matched) AS matched, count(DISTINCT seq) AS n_payloads,
  sum(length(title)) FILTER (matched) AS title_chars, sum(chars) FILTER (matched) AS description_chars
FROM ({page_view(*view, shown="length(description) AS chars", **named)}) GROUP BY source"""


_LD_TITLE, _OF_THE = "CASE WHEN ld THEN role ELSE {} END", matches("title", "of", "the")
_PAGES_OF_ALL = [
    _counted("cutshort", _LD_TITLE.format(f"rtrim({stripped('h1')}, ',')"), "''", "CASE WHEN ld THEN whole ELSE '' END", "''", "''", _OF_THE, "1", "true"),
    _counted("foundit", _LD_TITLE.format(stripped("h1")), "''", "CASE WHEN ld THEN whole ELSE '' END", "''", "''", _OF_THE, "1", "matched"),
    _counted("forage_ai", _LD_TITLE.format(collapsed("h1")), "''", f"""CASE WHEN ld THEN whole ELSE trim(array_to_string(list_transform(
  regexp_extract_all(article, '<p>([^<]+)', 1), lambda x: {collapsed(unescaped('x'))}), ' ')) END""", "''", "''",
             f"length(description) >= 100 AND {_OF_THE}", "1", "matched"),
    _counted("greenhouse_playwright", _LD_TITLE.format(collapsed("h1")), "''",
             f"CASE WHEN ld THEN whole ELSE {joined_text(chr(39) + '<i>Goa</i' + chr(39) + ' || article')} END", "''", "''", _OF_THE, "1", "matched"),
    _counted("foundit_demo", "CASE WHEN ld THEN role WHEN recorded THEN 'Found of the ' || page_id ELSE '' END", "''",
             "CASE WHEN ld THEN whole WHEN recorded THEN 'Found text' ELSE '' END", "''", "''", _OF_THE, "0", "matched"),
    _counted("indeed", "CASE WHEN recorded THEN 'Found of the ' || page_id ELSE '' END", "''", joined_text("article"), "''", "''", "true", "0", "matched"),
    _counted("ddg", f"CASE WHEN recorded THEN 'Found of the ' || page_id ELSE {stripped('page_title')} END", "''", "ld_text", "''", "''",
             "true", "0", "matched", with_cte=_DDG_PARTS),
]
ORACLES["union_all_sources"] = f"""WITH {LINES}, jobs AS (
  SELECT unnest(['arbeitnow', 'ashby', 'greenhouse', 'himalayas']) AS source, doc_id, line, {LINE_TEXT} AS description FROM lines WHERE {OF_THE}
  UNION ALL SELECT 'lever', doc_id, line, {collapsed("line || ' ' || line || ' end'")} FROM lines WHERE {OF_THE}), summed AS (
  SELECT source, count(*) AS fetched, count(*) AS matched, count(DISTINCT doc_id) AS n_payloads, sum(length(line)) AS title_chars,
    sum(length(description)) AS description_chars FROM jobs GROUP BY source
  UNION ALL {" UNION ALL ".join(f"({view})" for view in _PAGES_OF_ALL)}), found AS (
  SELECT unnest(['foundit_demo', 'indeed', 'ddg']) AS source, unnest([1, 1, 2]) * count(*) FILTER (starts_with(url, 'https:')) AS more FROM pages)
SELECT s.source, (coalesce(fetched, 0) + coalesce(more, 0))::BIGINT AS fetched, coalesce(matched, 0) AS matched, coalesce(n_payloads, 0) AS n_payloads,
  coalesce(title_chars, 0)::BIGINT AS title_chars, coalesce(description_chars, 0)::BIGINT AS description_chars
FROM (SELECT unnest(['arbeitnow', 'ashby', 'greenhouse', 'himalayas', 'lever', 'cutshort', 'foundit', 'forage_ai', 'greenhouse_playwright',
  'foundit_demo', 'indeed', 'ddg']) AS source) s LEFT JOIN summed USING (source) LEFT JOIN found USING (source)"""

# Pages by the last two bits of their number: the search record comes earlier, at once, later or never.
ORACLES["ingest_captures_pages"] = f"""WITH {PAGE_PARTS} SELECT url, page_id AS seq, md5({joined_text("article")}) AS digest,
  CASE WHEN page_id % 4 < 3 THEN 'Found of the ' || page_id ELSE '-' END AS title, CASE WHEN page_id % 4 < 3 THEN 'Finder' ELSE '-' END AS company FROM p"""
ORACLES["ingest_captures"] = f"""WITH {PAGE_PARTS}, {LINES}, found AS (
  SELECT page_id, url, {joined_text("article")} AS description FROM p WHERE page_id % 4 < 3), kept AS (
  SELECT * FROM found WHERE description <> ''), feed AS (
  SELECT doc_id, pos, {collapsed("line || ' ' || line || ' end'")} AS description FROM lines WHERE {OF_THE})
SELECT 'indeed' AS source, (SELECT count(*) FROM found) AS fetched, count(*) AS stored, 0 AS skipped_dedup, count(*) AS listings,
  count(*) AS found_titles, count(*) AS found_companies, sum(length(description))::BIGINT AS chars FROM kept
UNION ALL
SELECT 'lever', count(*), 1, count(*) - 1, 1, 0, 0, arg_min(length(description), (doc_id, pos)) FROM feed"""
