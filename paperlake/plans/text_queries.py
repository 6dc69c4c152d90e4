"""Queries and SQL of scalar functions, identifiers, questions and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import ids, questions, text
from paperlake.operators import chunking
from paperlake.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

WS = r"[ \t\n\x0B\f\r]"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents"), "doc_id")


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Every message is asked; which of them are questions is not read off the role, which is spelt in many ways."""
    return table(s, d, "messages").where("content IS NOT NULL").select("id", "loaded_at", "content")


_ASKED = "(SELECT id, loaded_at, content FROM messages WHERE content IS NOT NULL)"


@query(
    "tokenize_alnum",
    f"""SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\x0B\\f\\r]', ' ', 'g'), '{WS}+'),
 lambda t: length(t) > 1) AS tokens FROM documents WHERE text IS NOT NULL""",
)
def tokenize_alnum(s, d):
    return _docs(s, d).where("text IS NOT NULL").select("doc_id", text.alnum_tokens(F.col("text")).alias("tokens"))


@query("tokenize_space", f"SELECT doc_id, {words_sql('lower(text)')} AS tokens FROM documents WHERE text IS NOT NULL")
def tokenize_space(s, d):
    return _docs(s, d).where("text IS NOT NULL").select("doc_id", text.space_tokens(F.col("text")).alias("tokens"))


_STRIP = ".,?!:;()[]{}\"''"
_KEY = f"""list_filter(list_transform({words_sql('lower(content)')}, lambda t: trim(t, '{_STRIP}')),
 lambda t: t NOT IN ({_in(text.KEY_STOPWORDS)}) AND length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+'))"""


@query("key_terms", f"SELECT id, loaded_at, {_KEY} AS terms FROM {_ASKED}")
def key_terms(s, d):
    return _asked(s, d).select("id", "loaded_at", text.key_terms(F.col("content")).alias("terms"))


_MARK = " + ".join(f"contains(lower(content), '{m}')::int" for m in text.COMPLEX_MARKERS)
_CPX = f"""(least(1.0::double, len(w) / 25.0::double) * 0.4 + least(1.0::double, list_sum(list_transform(w, lambda t: length(t))) / greatest(1, len(w)) / 8.0::double) * 0.2
 + least(1.0::double, (length(content) - length(replace(content, '?', ''))) / 2.0::double) * 0.1 + least(1.0::double, ({_MARK}) / 2.0::double) * 0.3)"""


@query(
    "query_complexity",
    f"""SELECT id, loaded_at, round(coalesce({_CPX.replace('list_sum(', 'coalesce(list_sum(').replace(') / greatest(', '), 0) / greatest(', 1)}, 0)::double, 6) AS complexity
 FROM (SELECT *, {words_sql('content')} AS w FROM {_ASKED})""",
)
def query_complexity(s, d):
    return _asked(s, d).select("id", "loaded_at", F.round(text.complexity(F.col("content")), 6).alias("complexity"))


_CPX_SQL = _CPX.replace("list_sum(", "coalesce(list_sum(").replace(") / greatest(", "), 0) / greatest(", 1)


@query(
    "sampling_temperature",
    f"""SELECT id, loaded_at, CASE WHEN c > 0.7 THEN 0.7 ELSE 0.3 END::double AS advanced, CASE WHEN c < 0.7 THEN 0.3 ELSE 0.5 END::double AS profound
 FROM (SELECT id, loaded_at, {_CPX_SQL} AS c FROM (SELECT *, {words_sql('content')} AS w FROM {_ASKED}))""",
)
def sampling_temperature(s, d):
    c = text.complexity(F.col("content"))
    return _asked(s, d).select("id", "loaded_at", text.temperature(c).alias("advanced"), text.temperature(c, "profound").alias("profound"))


_NORM = "translate(lower(strip_accents(replace(replace(title, '…', '...'), chr(160), ' '))), '–—−‐', '----')"


@query("normalize_text", f"SELECT paper_no, {_NORM} AS normal FROM papers WHERE title IS NOT NULL")
def normalize_text(s, d):
    return table(s, d, "papers").where("title IS NOT NULL").select("paper_no", text.normalized(F.col("title")).alias("normal"))


@query(
    "title_tokens",
    f"""SELECT paper_no, list_sort(list_distinct(list_filter(regexp_extract_all({_NORM}, '[a-z0-9]+'),
 lambda t: length(t) > 1 AND t NOT IN ({_in(text.SET_STOPWORDS)})))) AS tokens FROM papers WHERE title IS NOT NULL""",
)
def title_tokens(s, d):
    p = table(s, d, "papers").where("title IS NOT NULL")
    return p.select("paper_no", F.sort_array(text.token_set(text.normalized(F.col("title")))).alias("tokens"))


@query(
    "token_estimate",
    "SELECT doc_id, coalesce(length(text) // 4 + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) // 2, 0)::bigint AS tokens FROM documents",
)
def token_estimate(s, d):
    return _docs(s, d).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(
    "truncate_tokens",
    r"""SELECT doc_id, CASE WHEN length(text) > 400 THEN CASE WHEN contains(left(text, 400), ' ')
 THEN regexp_extract(left(text, 400), '(?s)^(.*) [^ ]*$', 1) ELSE left(text, 400) END || '...' ELSE text END AS cut FROM documents WHERE text IS NOT NULL""",
)
def truncate_tokens(s, d):
    return _docs(s, d).where("text IS NOT NULL").select("doc_id", text.truncated(F.col("text"), 100).alias("cut"))


@query(
    "clean_pdf_text",
    f"""SELECT doc_id, CASE WHEN length(text) - length(replace(text, chr(10), '')) > length(text) * 0.05
 THEN trim(regexp_replace(text, '{WS}+', ' ', 'g')) ELSE text END AS clean FROM documents WHERE text IS NOT NULL""",
)
def clean_pdf_text(s, d):
    return _docs(s, d).where("text IS NOT NULL").select("doc_id", text.pdf_text(F.col("text")).alias("clean"))


@query("split_fused", r"SELECT paper_no, regexp_replace(journal, '([a-z])([A-Z][a-z])', '\1 \2', 'g') AS journal FROM papers WHERE journal IS NOT NULL")
def split_fused(s, d):
    return table(s, d, "papers").where("journal IS NOT NULL").select("paper_no", text.unfused(F.col("journal")).alias("journal"))


@query(
    "title_fingerprint",
    "SELECT paper_no, left(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 120) AS fingerprint FROM papers WHERE title IS NOT NULL",
)
def title_fingerprint(s, d):
    return table(s, d, "papers").where("title IS NOT NULL").select("paper_no", text.fingerprint(F.col("title")).alias("fingerprint"))


_DOI = r"trim(regexp_replace(lower(trim(coalesce(doi, ''))), '^(?:https://doi\.org/|http://dx\.doi\.org/|doi:)\s*', ''))"


@query("doi_normalize", rf"SELECT paper_no, regexp_replace({_DOI}, '[.,);]+$', '') AS match_doi, {_DOI} AS key_doi FROM papers")
def doi_normalize(s, d):
    return table(s, d, "papers").select("paper_no", ids.doi(F.col("doi")).alias("match_doi"), ids.doi_key(F.col("doi")).alias("key_doi"))


@query(
    "paper_ids",
    """SELECT paper_no, CASE WHEN doi <> '' THEN 'doi:' || lower(doi) WHEN pmid <> '' THEN 'pmid:' || pmid WHEN url <> '' THEN url
 ELSE 'generated:' || left(md5(coalesce(title, '')), 12) END AS paper_id FROM papers""",
)
def paper_ids(s, d):
    return table(s, d, "papers").select("paper_no", ids.paper_id(*(F.col(c) for c in ("doi", "pmid", "title", "url"))).alias("paper_id"))


@query(
    "publisher_route",
    rf"""SELECT paper_no, CASE split_part(regexp_replace({_DOI}, '[.,);]+$', ''), '/', 1)
 {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ids.PUBLISHERS.items())} END AS publisher,
 CASE WHEN regexp_matches(trim(doi), '^(?:DOI:|ArXiv:|PMID:|CorpusId:|https://|http://)') THEN trim(doi)
 WHEN regexp_matches(trim(doi), '^10\.\d{{4,9}}/') THEN 'DOI:' || trim(doi)
 WHEN regexp_matches(trim(doi), '(?i)^\d{{4}}\.\d{{4,5}}(?:v\d+)?$') OR regexp_matches(trim(doi), '(?i)^[a-z-]+/\d{{7}}$') THEN 'ArXiv:' || trim(doi)
 ELSE trim(doi) END AS scholar_id,
 coalesce(starts_with(lower(doi), '10.48550/') OR contains(lower(doi), 'arxiv'), false) AS arxiv FROM papers""",
)
def publisher_route(s, d):
    x = F.col("doi")
    return table(s, d, "papers").select(
        "paper_no", ids.publisher(x).alias("publisher"), ids.scholar_id(x).alias("scholar_id"), ids.is_arxiv_doi(x).alias("arxiv")
    )


@query(
    "kb_names",
    """SELECT name, nullif(regexp_replace(regexp_replace(regexp_replace(replace(trim(description), ' ', '_'), '[^a-zA-Z0-9_-]+', '_', 'g'), '_+', '_', 'g'),
 '^_+|_+$', '', 'g'), '') AS display, 'kb_' || replace(name, ' ', '_') AS collection FROM kb_metadata""",
)
def kb_names(s, d):
    return table(s, d, "kb_metadata").select(
        "name", ids.kb_display(F.col("description")).alias("display"), ids.kb_collection(F.col("name")).alias("collection")
    )


@query(
    "date_years",
    r"""SELECT record_no, CASE WHEN regexp_extract(date_text, '^(\d{4})', 1) <> '' THEN regexp_extract(date_text, '^(\d{4})', 1)::int
 WHEN regexp_matches(date_text, '^\d{1,8}-') THEN regexp_extract(date_text, '^(\d+)-', 1)::int END AS "year" FROM search_records""",
)
def date_years(s, d):
    return table(s, d, "search_records").select("record_no", ids.year_of_date(F.col("date_text")).alias("year"))


_TAG = "CASE WHEN trim(content) = '' THEN '' " + " ".join(
    f"WHEN regexp_matches(content, '(?i){p}') THEN '{t}'" for p, t in questions.COMPOSITE
) + " ELSE '' END"


@query(
    "intent_heuristic",
    f"SELECT id, loaded_at, {_TAG} AS tag, CASE WHEN {_TAG} <> '' THEN 'composite' ELSE 'simple' END AS complexity FROM {_ASKED}",
)
def intent_heuristic(s, d):
    tag = questions.composite_tag(F.col("content"))
    return _asked(s, d).select("id", "loaded_at", tag.alias("tag"), questions.complexity(tag).alias("complexity"))


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + ")"


@query(
    "intent_keywords",
    f"""SELECT id, loaded_at, CASE WHEN {_has(questions.COMPOUND_WORDS)} AND {_has(questions.COMPOUND_ONLY)} THEN 'NATURAL_PRODUCTS_ONLY'
 WHEN {_has(questions.COMPOUND_WORDS)} THEN 'COMBINED_RESEARCH' WHEN {_has(questions.PAPER_WORDS)} THEN 'PAPERS_ONLY' ELSE 'COMBINED_RESEARCH' END AS intent
 FROM {_ASKED}""",
)
def intent_keywords(s, d):
    return _asked(s, d).select("id", "loaded_at", questions.intent(F.col("content"))["intent"].alias("intent"))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


_BARE = _strip("content")
_CLEAN = "CASE " + " ".join(
    f"WHEN starts_with(lower({_strip('content')}), '{p.replace(chr(39), chr(39) * 2)}') THEN {_strip(f'substr({_BARE}, {len(p) + 1})')}"
    for p in questions.OPENINGS
) + f" ELSE {_strip('content')} END"


@query("query_cleanup", f"SELECT id, loaded_at, {_CLEAN} AS cleaned FROM {_ASKED}")
def query_cleanup(s, d):
    return _asked(s, d).select("id", "loaded_at", questions.cleaned(F.col("content")).alias("cleaned"))


_AND = r"'(?s)^(.*?)\band\b(?:\s+(?:its|their|the))?\s+(.*)$'"
_VS = r"'(?is)^(.*?)(?:\s+vs\.?\s+|\s+versus\s+)(.*)$'"
_BOTH = r"'(?is)^(.*?)\s+and\s+(.*)$'"


@query(
    "query_decompose",
    f"""WITH t AS (SELECT id, loaded_at, {_strip('content')} t FROM {_ASKED}),
 x AS (SELECT *, {_strip(f'regexp_extract(t, {_VS}, 1)')} a, {_strip(f'regexp_extract(t, {_VS}, 2)')} b, {_strip(f'regexp_extract(t, {_AND}, 1)')} c,
 {_strip(f'regexp_extract(t, {_AND}, 2)')} e, {_strip(f'regexp_extract(t, {_BOTH}, 1)')} f, {_strip(f'regexp_extract(t, {_BOTH}, 2)')} g FROM t)
 SELECT id, loaded_at, CASE WHEN length(a) > 2 AND length(b) > 2 THEN [a, b] WHEN length(c) > 5 AND length(e) > 3 THEN [c, c || ' ' || e]
 WHEN length(f) > 3 AND length(g) > 3 THEN [f, g] ELSE [t] END AS phrases FROM x""",
)
def query_decompose(s, d):
    return _asked(s, d).select("id", "loaded_at", questions.subqueries(F.col("content")).alias("phrases"))


@query(
    "reference_lines",
    """SELECT paper_no, '[' || paper_no || '] ' || coalesce(title, 'None') || CASE WHEN journal <> '' THEN ' - ' || journal ELSE '' END
 || CASE WHEN "year" IS NOT NULL THEN ' (' || "year" || ')' ELSE '' END || CASE WHEN doi <> '' THEN ' - DOI: ' || doi ELSE '' END AS line FROM papers""",
)
def reference_lines(s, d):
    c = F.col
    return table(s, d, "papers").select("paper_no", text.reference_line(c("paper_no"), c("title"), c("journal"), c("year"), c("doi")).alias("line"))


@query(
    "author_display",
    r"""WITH a AS (SELECT paper_no, list_transform(list_filter(list_transform(authors, lambda p: p.name), lambda n: n IS NOT NULL),
 lambda n: regexp_extract(trim(n), '([^ \t\n\x0B\f\r]+)$', 1)) AS l FROM papers)
 SELECT paper_no, CASE len(l) WHEN 0 THEN NULL WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' & ' || l[2] ELSE l[1] || ' et al.' END AS display FROM a
 WHERE l IS NOT NULL""",
)
def author_display(s, d):
    names = F.filter(F.transform("authors", lambda p: p["name"]), lambda n: n.isNotNull())
    return table(s, d, "papers").where("authors IS NOT NULL").select("paper_no", text.author_display(names).alias("display"))


@query(
    "academic_references",
    r"""WITH p AS (SELECT paper_no, coalesce(list_filter(list_transform(authors, lambda a: a.name), lambda n: n IS NOT NULL), []) n, coalesce(title, 'Unknown Title') t,
 coalesce("year"::varchar, 'n.d.') y, trim(regexp_replace(trim(doi), '(?i)^(?:https://doi\.org/|http://dx\.doi\.org/|doi:)\s*', '')) d FROM papers),
 w AS (SELECT *, CASE len(n) WHEN 0 THEN 'Unknown' WHEN 1 THEN n[1] WHEN 2 THEN n[1] || ' & ' || n[2] ELSE n[1] || ' et al.' END who FROM p)
 SELECT paper_no, CASE WHEN coalesce(d, '') <> '' THEN paper_no || '. [' || who || ', ' || y || '](https://doi.org/' || d || ' "'
 || CASE WHEN len(n) > 0 THEN array_to_string(n, ', ') || '. ' || y || '. ' || t || '.' ELSE t || '. ' || y || '.' END || '")'
 ELSE paper_no || '. ' || who || ', ' || y || '. ' || t || '.' END AS line FROM w""",
)
def academic_references(s, d):
    names = F.filter(F.transform("authors", lambda p: p["name"]), lambda n: n.isNotNull())
    c = F.col
    return table(s, d, "papers").select(
        "paper_no", text.academic_reference(c("paper_no"), c("title"), F.coalesce(names, F.array().cast("array<string>")), c("year"), c("doi")).alias("line")
    )


@query(
    "paper_blocks",
    """SELECT doc_id, '[Paper ' || doc_id || ']' || CASE WHEN section <> '' THEN ' ' || section ELSE '' END || CASE WHEN source <> '' THEN ' — ' || source ELSE '' END || ' | relevance: 0.50' || chr(10) || chr(10)
 || CASE WHEN length(text) > 600 THEN left(text, 600) || chr(10) || '[...truncated]' ELSE coalesce(text, '') END AS block FROM documents""",
)
def paper_blocks(s, d):
    c = F.col
    null = F.lit(None).cast("string")
    block = text.paper_block(c("doc_id"), c("section"), c("source"), null, null, F.lit(0.5), c("text"), 600)
    return _docs(s, d).select("doc_id", block.alias("block"))


@query(
    "citation_extract",
    r"""SELECT doc_id, list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(text, '\[(\d+(?:\s*,\s*\d+)*)\]', 1),
 lambda g: regexp_split_to_array(g, '\s*,\s*'))), lambda n: n::int))) AS cited FROM documents WHERE text IS NOT NULL""",
)
def citation_extract(s, d):
    return _docs(s, d).where("text IS NOT NULL").select("doc_id", text.cited(F.col("text")).alias("cited"))


_CHUNKS = f"""c AS (SELECT doc_id, i // 80 AS chunk_index, array_to_string(w[i + 1 : i + 100], ' ') AS chunk, n FROM (
 SELECT doc_id, w, len(w) n, unnest(range(0, len(w), 80)) AS i FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents WHERE text IS NOT NULL)))"""


@query("chunk_words", f"WITH {_CHUNKS} SELECT doc_id, chunk_index::int AS chunk_index, chunk FROM c")
def chunk_words(s, d):
    return chunking.word_windows(_docs(s, d), "doc_id", "text", 100, 20)


@query(
    "chunk_overlap_trim",
    f"""WITH {_CHUNKS}, p AS (SELECT doc_id, chunk_index, chunk, string_split(chunk, ' ') AS cw,
 lag(string_split(chunk, ' ')) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS pw FROM c),
 t AS (SELECT *, pw[greatest(1, len(pw) - 19):] AS tail FROM p),
 m AS (SELECT *, list_filter(range(least(len(tail), len(cw)), 0, -1), lambda m: tail[1:m] = cw[1:m]) AS hits FROM t)
 SELECT doc_id, chunk_index::int AS chunk_index, CASE WHEN len(hits) > 0 THEN array_to_string(cw[hits[1] + 1:], ' ') ELSE chunk END AS trimmed FROM m""",
)
def chunk_overlap_trim(s, d):
    c = chunking.word_windows(_docs(s, d), "doc_id", "text", 100, 20)
    return chunking.untrimmed(c, "doc_id", 20).select("doc_id", "chunk_index", "trimmed")


@query(
    "chunk_proportional",
    f"""WITH w AS (SELECT doc_id, text, len({words_sql('text')}) n FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, text, n, unnest(range(0, n, 80)) s FROM w),
 c AS (SELECT doc_id, s, floor(s / n * length(text))::int cs, floor(least(s + 100, n) / n * length(text))::int ce, text FROM s WHERE s = 0 OR s - 80 + 100 < n),
 t AS (SELECT doc_id, s, regexp_replace(substr(text, cs + 1, ce - cs), '^{WS}+|{WS}+$', '', 'g') chunk FROM c)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::int AS chunk_index, chunk FROM t WHERE chunk <> ''""",
)
def chunk_proportional(s, d):
    return chunking.proportional(_docs(s, d), "doc_id", "text", 100, 20)


_SECTIONS = rf"""l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) l, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1) i
 FROM documents WHERE text IS NOT NULL), h AS (SELECT *, regexp_matches(regexp_replace(l, '^{WS}+|{WS}+$', '', 'g'), '{chunking.SECTION}') h FROM l),
 n AS (SELECT *, sum(h::int) OVER (PARTITION BY doc_id ORDER BY i) no FROM h),
 p AS (SELECT doc_id, no, coalesce(max(regexp_replace(l, '^{WS}+|{WS}+$', '', 'g')) FILTER (h), '_full') section,
 regexp_replace(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT h), ''), '^{WS}+|{WS}+$', '', 'g') content FROM n GROUP BY doc_id, no)"""


@query(
    "section_split",
    f"""WITH {_SECTIONS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1)::int AS section_index, section, content FROM p
 WHERE content <> '' AND NOT regexp_matches(section, '{chunking.REFERENCES}')""",
)
def section_split(s, d):
    return chunking.sections(_docs(s, d), "doc_id", "text")


@query("chunk_sections")
def chunk_sections(s, d):
    return chunking.in_sections(_docs(s, d), "doc_id", "text", 100, 20)


@query("sentence_split")
def sentence_split(s, d):
    return chunking.sentences(_docs(s, d), "doc_id", "text")


@query("chunk_semantic")
def chunk_semantic(s, d):
    return chunking.semantic(_docs(s, d), "doc_id", "text")


@query("chunk_paragraphs")
def chunk_paragraphs(s, d):
    return chunking.paragraphs(_docs(s, d), "doc_id", "text")


@query(
    "metadata_chunks",
    """SELECT paper_no AS paper_id, 0 AS chunk_index, concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END,
 CASE WHEN journal <> '' THEN 'Authors: ' || journal END, CASE WHEN "year" IS NOT NULL THEN 'Year: ' || "year" END,
 CASE WHEN doi <> '' THEN 'DOI: ' || doi END, CASE WHEN abstract <> '' THEN 'Abstract: ' || abstract END) AS chunk FROM papers""",
)
def metadata_chunks(s, d):
    p = table(s, d, "papers").select(F.col("paper_no").alias("paper_id"), "title", F.col("journal").alias("authors"), "year", "doi", "abstract")
    return chunking.metadata_chunk(p)


@query(
    "answer_pieces",
    """SELECT doc_id, i::int AS seq, substr(text, i * 100 + 1, 100) AS delta FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 100 + 1)) AS i
 FROM documents WHERE length(text) > 0)""",
)
def answer_pieces(s, d):
    return chunking.pieces(_docs(s, d), "doc_id", "text", 100)
