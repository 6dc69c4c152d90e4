"""Queries and SQL of evidence, conversations, surveys, stores and sources over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake import connectors
from paperlake.functions import ids, questions, text
from paperlake.operators import chunking, conversation, evidence, scope, store, survey
from paperlake.plans import engine
from paperlake.plans.text_queries import _DOI
from paperlake.session import cut, spread, table
from paperlake.sources import bibtex, services
from paperlake.streaming import events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _papers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers")


_KEY = f"""k AS (SELECT *, left(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '', 'g'), 120) fp, {_DOI} nd FROM papers),
 kk AS (SELECT *, CASE WHEN length(fp) >= 40 THEN 'title:' || fp WHEN nd <> '' THEN 'doi:' || nd WHEN trim(coalesce(id, '')) <> '' THEN 'oa:' || trim(id)
 WHEN fp <> '' THEN 'title:' || fp WHEN title <> '' THEN 'unknown:' || paper_no END key FROM k),
 best AS (SELECT key, arg_max(paper_no, (coalesce(length(full_text), 0), coalesce(length(abstract), 0), coalesce(citation_count, 0), coalesce("year", 0),
 CASE WHEN starts_with(nd, '10.1101') THEN 0 ELSE 1 END, -paper_no)) paper_no, min(paper_no) first_pos FROM kk WHERE key IS NOT NULL GROUP BY key)"""


@query("dedupe_keep_best", f"WITH {_KEY} SELECT paper_no, first_pos FROM best")
def dedupe_keep_best(s, d):
    return evidence.keep_best(_papers(s, d), "paper_no").select("paper_no", "first_pos")


@query(
    "source_list",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY source, title ORDER BY paper_no) n FROM papers WHERE source IS NOT NULL),
 p AS (SELECT source, paper_no, row_number() OVER (PARTITION BY source ORDER BY paper_no) place FROM o WHERE n = 1) SELECT source, paper_no, place FROM p WHERE place <= 10""",
)
def source_list(s, d):
    return evidence.source_list(_papers(s, d).where("source IS NOT NULL"), "source", "paper_no").select("source", "paper_no", "place")


# Facets are journals; their evidence is the search records, relevance from citations, full text where there is an abstract.
def _entries(s, d) -> DataFrame:
    r = table(s, d, "search_records")
    return r.select(
        F.col("record_no").alias("pos"), F.coalesce(F.lower("publication_title"), F.lit("main")).alias("facet"), "doi", "title",
        F.when(F.col("citation_count").isNotNull(), F.col("citation_count") % 5 + 1).alias("relevance"), (F.length("abstract_note") > 200).alias("full_text"),
    )


_ENT = """e AS (SELECT record_no pos, coalesce(lower(publication_title), 'main') facet, doi, title,
 CASE WHEN citation_count IS NOT NULL THEN citation_count % 5 + 1 END relevance, length(abstract_note) > 200 full_text FROM search_records),
 ek AS (SELECT *, CASE WHEN trim(coalesce(doi, '')) <> '' THEN 'doi:' || lower(trim(doi)) WHEN trim(coalesce(title, '')) <> ''
 THEN 'title:' || left(lower(trim(title)), 120) ELSE '#' || pos END k FROM e),
 ea AS (SELECT * FROM ek QUALIFY row_number() OVER (PARTITION BY facet, k ORDER BY pos) = 1),
 fn AS (SELECT lower(journal) facet FROM papers WHERE journal IS NOT NULL UNION SELECT 'main'),
 fs AS (SELECT fn.facet, coalesce(n, 0) n, CASE WHEN coalesce(n, 0) = 0 THEN 'gap' WHEN n <= 2 THEN 'partial' ELSE 'covered' END status,
 CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE round(0.45 * least(n / 5, 1) + 0.35 * least(greatest((r - 1) / 4, 0), 1) + 0.20 * f, 4) END confidence
 FROM fn LEFT JOIN (SELECT facet, count(*) n, avg(coalesce(relevance, 3)) r, avg(coalesce(full_text, false)::int) f FROM ea GROUP BY facet) USING (facet))"""


def _facet_names(s, d) -> DataFrame:
    main = s.range(1).select(F.lit("main").alias("facet"))
    return _papers(s, d).where("journal IS NOT NULL").select(F.lower("journal").alias("facet")).unionByName(main).distinct()


@query("evidence_dedupe", f"WITH {_ENT} SELECT facet, pos FROM ea")
def evidence_dedupe(s, d):
    return evidence.accumulated(_entries(s, d), "facet", "pos").select("facet", "pos")


@query("facet_confidence", f"WITH {_ENT} SELECT facet, n, status, confidence FROM fs")
def facet_confidence(s, d):
    return evidence.facets(_facet_names(s, d), evidence.accumulated(_entries(s, d), "facet", "pos"), "facet")


@query("overall_confidence", f"""WITH {_ENT} SELECT round(avg(confidence), 6) AS confidence, count(*) FILTER (status = 'gap') AS gaps,
 string_agg(facet || '=' || status || '/' || confidence::varchar, ';' ORDER BY facet) AS parts FROM fs""")
def overall_confidence(s, d):
    o = evidence.overall(facet_confidence(s, d))
    part = lambda k: F.concat(k, F.lit("="), F.col("statuses")[k], F.lit("/"), F.col("confidences")[k].cast("string"))
    return o.select(F.round("confidence", 6).alias("confidence"), "gaps", F.array_join(F.transform(F.array_sort(F.map_keys("statuses")), part), ";").alias("parts"))


@query(
    "last_evidence",
    f"""WITH {_ENT} SELECT facet, pos FROM ea QUALIFY row_number() OVER (PARTITION BY facet ORDER BY pos DESC) <= 7""",
)
def last_evidence(s, d):
    return evidence.last_entries(evidence.accumulated(_entries(s, d), "facet", "pos"), "facet", "pos").select("facet", "pos")


@query(
    "recent_found",
    """WITH l AS (SELECT paper_no, left(lower(coalesce(title, '')), 100) k FROM papers ORDER BY paper_no DESC LIMIT 40),
 o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY k ORDER BY paper_no) = 1) SELECT paper_no FROM o ORDER BY paper_no LIMIT 20""",
)
def recent_found(s, d):
    return evidence.recent_found(_papers(s, d), "paper_no", 20).select("paper_no")


@query(
    "relevance_filter",
    """SELECT paper_no, CASE WHEN kb THEN greatest(coalesce(score, 3), 3) ELSE score END AS score FROM (SELECT p.paper_no, p.source = 'bibtex' kb, s.score FROM papers p
 LEFT JOIN (SELECT paper_no, citation_count % 5 + 1 score FROM papers WHERE citation_count IS NOT NULL) s USING (paper_no))
 WHERE CASE WHEN kb THEN greatest(coalesce(score, 3), 3) ELSE score END >= 3""",
)
def relevance_filter(s, d):
    p = _papers(s, d)
    scores = p.where("citation_count IS NOT NULL").select("paper_no", (F.col("citation_count") % 5 + 1).alias("score"))
    return evidence.relevant(p.withColumn("from_kb", F.col("source") == "bibtex"), scores, "paper_no", 3).select("paper_no", "score")


@query(
    "citation_check",
    r"""WITH f AS (SELECT doc_id, list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(text, '\[(\d+(?:\s*,\s*\d+)*)\]', 1),
 lambda g: regexp_split_to_array(g, '\s*,\s*'))), lambda n: n::int))) c FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, list_filter(c, lambda n: n BETWEEN 1 AND 50) AS cited, list_filter(c, lambda n: n NOT BETWEEN 1 AND 50) AS invalid,
 len(list_filter(c, lambda n: n BETWEEN 1 AND 50))::int AS cited_count FROM f""",
)
def citation_check(s, d):
    c = evidence.citation_check(F.col("text"), F.lit(50))
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", c.alias("c")).select("doc_id", "c.cited", "c.invalid", "c.cited_count")


@query("citation_rewrite")
def citation_rewrite(s, d):
    docs = table(s, d, "documents").where("text IS NOT NULL")
    clean = docs.select("doc_id", evidence.verified(F.col("text"), F.lit(50)).alias("verified"))
    return clean.select("doc_id", "verified", evidence.compacted(F.col("verified"), text.cited(F.col("verified"))).alias("compact"))


def _messages(s, d) -> DataFrame:
    m = table(s, d, "messages").where("conversation_id IS NOT NULL")
    one = store.first_seen(m, ["id"], "loaded_at")
    return one.select("conversation_id", "id", "timestamp", F.lower(F.trim("role")).alias("role"), "content")


_M = """m AS (SELECT conversation_id, id, "timestamp" ts, lower(trim(role)) AS role, content FROM messages WHERE conversation_id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"""
_EST = "(coalesce(length({0}) // 4 + length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')) // 2, 0))"
_MT = f"({_EST.format('role')} + {_EST.format('content')} + 4)"
_ORDER = ["timestamp", "id"]


@query("conversation_tokens", f"WITH {_M} SELECT conversation_id, count(*) AS messages, (sum({_MT}) + 2)::bigint AS tokens FROM m GROUP BY ALL")
def conversation_tokens(s, d):
    return conversation.conversation_tokens(_messages(s, d), "conversation_id")


@query(
    "conversation_window",
    f"WITH {_M} SELECT conversation_id, id FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY ts DESC NULLS LAST, id DESC) <= 4",
)
def conversation_window(s, d):
    return conversation.latest(_messages(s, d), "conversation_id", _ORDER, 4).select("conversation_id", "id")


@query(
    "token_budget",
    f"""WITH {_M}, t AS (SELECT *, {_MT} t, coalesce(role = 'system', false) sys FROM m),
 a AS (SELECT conversation_id, sum(t) + 2 total, coalesce(sum(t) FILTER (sys), 0) + 2 fixed FROM t GROUP BY 1),
 r AS (SELECT t.*, sum(t + 2) OVER (PARTITION BY conversation_id, sys ORDER BY ts DESC NULLS LAST, id DESC ROWS UNBOUNDED PRECEDING) run FROM t)
 SELECT conversation_id, id FROM r JOIN a USING (conversation_id) WHERE total <= 500 OR sys OR run <= 500 - fixed""",
)
def token_budget(s, d):
    return conversation.within_budget(_messages(s, d), "conversation_id", _ORDER, 500).select("conversation_id", "id")


@query("conversation_block")
def conversation_block(s, d):
    return conversation.block(_messages(s, d), "conversation_id", _ORDER)


@query(
    "conversation_assemble",
    f"""WITH {_M}, c AS (SELECT id conversation_id, title FROM conversations QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)
 SELECT conversation_id, id, title, row_number() OVER (PARTITION BY conversation_id ORDER BY ts NULLS FIRST, id) AS n FROM m JOIN c USING (conversation_id)""",
)
def conversation_assemble(s, d):
    c = store.first_seen(table(s, d, "conversations"), ["id"], "loaded_at")
    return conversation.assembled(c, _messages(s, d), _ORDER).select("conversation_id", "id", "title", "n")


@query(
    "cost_estimate",
    f"""WITH {_M}, c AS (SELECT conversation_id, (sum({_MT}) + 2)::bigint t FROM m GROUP BY 1)
 SELECT conversation_id, round(t / 1000 * 0.005 + 500 / 1000 * 0.015, 9) AS cost, least(128000 - t, 4096) AS available FROM c""",
)
def cost_estimate(s, d):
    c = conversation.conversation_tokens(_messages(s, d), "conversation_id")
    model = F.lit("gpt-4o")
    return c.select(
        "conversation_id", F.round(conversation.cost(model, F.col("tokens"), F.lit(500)), 9).alias("cost"),
        conversation.available(model, F.col("tokens")).alias("available"),
    )


def _survey(s, d) -> DataFrame:
    p = _papers(s, d)
    rel = F.when(F.col("citation_count") >= 0, F.col("citation_count") % 5 + 0.5)
    return p.select(F.col("paper_no").alias("pid"), "year", F.col("citation_count").alias("citations"), rel.cast("double").alias("relevance"), F.col("paper_no").alias("pos"))


def _themes(s, d) -> DataFrame:
    return _papers(s, d).select(F.col("paper_no").alias("pid"), F.explode("keywords").alias("theme"))


_SV = """p AS (SELECT paper_no pid, "year", citation_count citations, CASE WHEN coalesce(CASE WHEN citation_count >= 0 THEN citation_count % 5 + 0.5 END, 0) < 1
 THEN 2.0 ELSE citation_count % 5 + 0.5 END::double relevance FROM papers), r AS (SELECT * FROM p WHERE relevance >= 1.5),
 a AS (SELECT paper_no pid, unnest(keywords) theme FROM papers),
 t AS (SELECT theme, arg_max(pid, (coalesce(citations, 0), -pid)) pid, max(coalesce(citations, 0)) citations FROM a JOIN r USING (pid) GROUP BY theme),
 f1 AS (SELECT pid, min(theme) theme FROM t GROUP BY pid), rest AS (SELECT * FROM r WHERE pid NOT IN (SELECT pid FROM f1)),
 f2 AS (SELECT * FROM rest WHERE "year" >= 2021 ORDER BY relevance DESC, pid LIMIT 5),
 f3 AS (SELECT * FROM rest WHERE pid NOT IN (SELECT pid FROM f2) ORDER BY relevance DESC, coalesce(citations, 0) DESC, pid LIMIT 5000),
 al AS (SELECT pid, 'Highly cited in theme: ' || theme reason, 1 tier, row_number() OVER (ORDER BY theme) o FROM f1
 UNION ALL SELECT pid, 'Recent advance in the field', 2, row_number() OVER (ORDER BY relevance DESC, pid) FROM f2
 UNION ALL SELECT pid, 'Highly relevant to the topic', 3, row_number() OVER (ORDER BY relevance DESC, coalesce(citations, 0) DESC, pid) FROM f3),
 pl AS (SELECT *, row_number() OVER (ORDER BY tier, o) place FROM al)"""


@query("top_per_theme", f"WITH {_SV} SELECT theme, pid, citations FROM t")
def top_per_theme(s, d):
    p = survey.relevant(_survey(s, d))
    return survey.top_per_theme(p, _themes(s, d))


@query("recommend", f"WITH {_SV} SELECT pid, reason, place FROM pl WHERE tier < 3 OR place <= 5000")
def recommend(s, d):
    return survey.recommended(_survey(s, d), _themes(s, d), 2024, most=5000)


@query("theme_counts", "SELECT theme, count(DISTINCT paper_no) AS papers FROM (SELECT paper_no, unnest(keywords) theme FROM papers) GROUP BY theme")
def theme_counts(s, d):
    t = _themes(s, d)
    return survey.theme_counts(t.select("theme").distinct(), t)


@query(
    "first_nonnull_merge",
    """SELECT paper_id, arg_min(section, doc_id) FILTER (section <> '') AS section, arg_min(source, doc_id) FILTER (source <> '') AS source,
 arg_min(n_chars, doc_id) FILTER (n_chars IS NOT NULL) AS n_chars FROM documents GROUP BY paper_id""",
)
def first_nonnull_merge(s, d):
    return store.merged_metadata(table(s, d, "documents"), "paper_id", "doc_id", ["section", "source"], ["n_chars"])


@query("kb_stats", "SELECT source AS kb_name, count(*) AS chunks, count(DISTINCT paper_id) AS papers FROM documents GROUP BY source")
def kb_stats(s, d):
    return store.stats(table(s, d, "documents").withColumnRenamed("source", "kb_name"))


@query(
    "kb_live_counts",
    """SELECT name, coalesce(n, 0) AS chunk_count FROM kb_metadata LEFT JOIN (SELECT kb_name, count(*) n FROM conversations GROUP BY 1) ON kb_name = name""",
)
def kb_live_counts(s, d):
    live = table(s, d, "conversations").groupBy("kb_name").agg(F.count("*").alias("chunks"), F.countDistinct("session_id").alias("papers"))
    return store.with_live_counts(table(s, d, "kb_metadata"), live).select("name", "chunk_count")


@query("anti_join_new", "SELECT paper_no FROM papers WHERE id IS NULL OR id NOT IN (SELECT paper_id FROM documents WHERE paper_id IS NOT NULL)")
def anti_join_new(s, d):
    docs = table(s, d, "documents").select(F.col("paper_id").alias("id"))
    return store.without(_papers(s, d), docs, "id").select("paper_no")


@query("semi_join_ids", "SELECT doc_id FROM documents WHERE paper_id IN (SELECT id FROM papers WHERE \"year\" >= 2020)")
def semi_join_ids(s, d):
    wanted = _papers(s, d).where("year >= 2020").select(F.col("id").alias("paper_id"))
    return store.only(table(s, d, "documents"), wanted, "paper_id").select("doc_id")


@query("chunk_page", "SELECT doc_id FROM documents WHERE source = 'scilex' ORDER BY doc_id LIMIT 100 OFFSET 100")
def chunk_page(s, d):
    return store.page(table(s, d, "documents").where("source = 'scilex'").select("doc_id"), "doc_id", 500, 100)


@query(
    "searchable_papers",
    """SELECT paper_no FROM papers WHERE trim(coalesce(full_text, '')) <> '' OR (trim(coalesce(abstract, '')) <> ''
 AND NOT contains(lower(abstract), 'no abstract available'))""",
)
def searchable_papers(s, d):
    return store.searchable(_papers(s, d)).select("paper_no")


@query("quarantine", "SELECT paper_no FROM papers WHERE trim(coalesce(title, '')) = '' OR NOT coalesce(\"year\" BETWEEN 1800 AND 2020, true)")
def quarantine(s, d):
    """As in 2019: papers of later years than the next one are invalid."""
    return store.quarantined(_papers(s, d), 2019)[1].select("paper_no")


@query(
    "metadata_upsert",
    """WITH n AS (SELECT id, arg_max(title, loaded_at) title, max(loaded_at) loaded_at FROM conversations GROUP BY id) SELECT id, title FROM n""",
)
def metadata_upsert(s, d):
    c = table(s, d, "conversations").select("id", "title", "loaded_at")
    old = store.first_seen(c, ["id"], "loaded_at")
    new = c.groupBy("id").agg(F.max_by("title", "loaded_at").alias("title"), F.max("loaded_at").alias("loaded_at"))
    return store.upsert(old, new, ["id"]).select("id", "title")


@query(
    "inverted_abstract",
    r"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda t: t <> ''), ' ') AS text FROM documents
 WHERE text IS NOT NULL AND regexp_matches(text, '[^ \t\n\x0B\f\r]')""",
)
def inverted_abstract(s, d):
    rows = services.words_index(table(s, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", services.inverted_abstract(F.col("index")).alias("text"))


@query(
    "content_priority",
    """WITH c AS (SELECT paper_no, 'abstract' source, abstract AS text, 2 r, 20 least FROM papers UNION ALL SELECT paper_no, 'arxiv_html', full_text, 1, 200 FROM papers),
 b AS (SELECT paper_no, min(r) FILTER (length(trim(text)) > least) r FROM c GROUP BY 1) SELECT paper_no AS doi,
 CASE r WHEN 1 THEN 'arxiv_html' WHEN 2 THEN 'abstract' END AS source, CASE r WHEN 1 THEN 'structured' WHEN 2 THEN 'abstract' ELSE 'none' END AS content_type FROM b""",
)
def content_priority(s, d):
    p = _papers(s, d)
    a = p.select(F.col("paper_no").alias("doi"), F.lit("abstract").alias("source"), F.col("abstract").alias("text"))
    f = p.select(F.col("paper_no").alias("doi"), F.lit("arxiv_html").alias("source"), F.col("full_text").alias("text"))
    return services.best_content(a.unionByName(f)).select("doi", "source", "content_type")


@query(
    "zotero_map",
    r"""SELECT record_no, CASE WHEN doi <> '' THEN 'doi:' || lower(doi) WHEN url <> '' THEN url ELSE 'generated:' || left(md5(coalesce(nullif(title, ''), 'Untitled')), 12) END AS id,
 len(list_filter(list_transform(regexp_split_to_array(coalesce(author, ''), '\s*;\s*'), lambda a: trim(a)), lambda a: a <> ''))::int AS n_authors,
 try_cast(regexp_extract(coalesce(date_text, ''), '^(\d{1,6})(?:-|$)', 1) AS int) AS "year" FROM search_records""",
)
def zotero_map(s, d):
    return services.zotero_papers(table(s, d, "search_records")).select("record_no", "id", F.size("authors").alias("n_authors"), "year")


@query("bibtex_documents")
def bibtex_documents(s, d):
    docs = table(s, d, "documents").where(F.col("text").rlike(r"@\w+\s*\{"))
    rows = bibtex.normalized(bibtex.entries(docs, "text", "doc_id"))
    return rows.select("doc_id", "entry_type", "key", F.to_json("fields").alias("fields"))


@query("cache_lookup", f"SELECT DISTINCT doi FROM papers WHERE doi IS NOT NULL AND lower(doi) NOT IN (SELECT lower(doi) FROM search_records WHERE doi IS NOT NULL)")  # noqa: F541
def cache_lookup(s, d):
    return services.cached(_papers(s, d).where("doi IS NOT NULL"), table(s, d, "search_records").select("doi", "record_no"))[1]


@query("union_sources", "SELECT 'papers' AS src, id, title FROM papers UNION ALL SELECT 'search_records', NULL, title FROM search_records")
def union_sources(s, d):
    p = _papers(s, d).select(F.lit("papers").alias("src"), "id", "title")
    return p.unionByName(table(s, d, "search_records").select(F.lit("search_records").alias("src"), "title"), allowMissingColumns=True)


@query(
    "answer_roundtrip",
    """SELECT id AS session, loaded_at::varchar AS loaded, md5(coalesce(content, '')) AS answer_md5 FROM messages
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1""",
)
def answer_roundtrip(s, d):
    m = store.first_seen(table(s, d, "messages"), ["id"], "loaded_at").select(F.col("id").alias("session"), "content", "loaded_at")
    got = events.collected(events.answer_events(m, "session", "content"))
    both = got.join(m.select("session", "loaded_at"), "session")
    return both.select("session", F.col("loaded_at").cast("string").alias("loaded"), F.md5("answer").alias("answer_md5"))


@query(
    "event_windows",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM events GROUP BY ALL""",
)
def event_windows(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.per_window(e, "ts", "event_type")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


def _scope_questions(s, d) -> DataFrame:
    """Questions that quote the title, or name the DOI, of every hundredth paper."""
    p = _papers(s, d).where("paper_no % 100 = 0 AND title IS NOT NULL")
    return p.select(F.col("paper_no").alias("qid"), F.concat(F.lit('What does "'), "title", F.lit('" say about '), F.coalesce("doi", F.lit("it"))).alias("q"))


_SCOPE_DOI = r"""q AS (SELECT paper_no qid, 'What does "' || title || '" say about ' || coalesce(doi, 'it') q FROM papers WHERE paper_no % 100 = 0 AND title IS NOT NULL),
 qd AS (SELECT qid, unnest(regexp_extract_all(q, '(?i)(10\.\d{4,9}/[^\s\])>''",]+)', 1)) raw FROM q),
 qn AS (SELECT DISTINCT qid, regexp_replace(lower(raw), '[.,);]+$', '') nd FROM qd),"""


@query(
    "scope_doi",
    f"""WITH {_SCOPE_DOI} pd AS (SELECT regexp_replace({_DOI}, '[.,);]+$', '') nd, min(paper_no) paper_id FROM papers WHERE doi <> '' GROUP BY 1)
 SELECT DISTINCT qid, paper_id FROM qn JOIN pd USING (nd) WHERE nd <> ''""",
)
def scope_doi(s, d):
    p = _papers(s, d).select(F.col("paper_no").alias("paper_id"), "doi", F.col("paper_no").alias("ord"))
    return scope.by_doi(_scope_questions(s, d), p, "qid", "q").select("qid", "paper_id")


@query("scope_title")
def scope_title(s, d):
    p = _papers(s, d).select(F.col("paper_no").alias("paper_id"), "title", F.col("paper_no").alias("ord"))
    return scope.by_title(_scope_questions(s, d), p, "qid", "q").select("qid", "place", "paper_id", F.round("score", 6).alias("score"))


@query("scope_resolve")
def scope_resolve(s, d):
    p = _papers(s, d).select(F.col("paper_no").alias("paper_id"), "title", "doi", F.col("paper_no").alias("ord"))
    return scope.resolved(_scope_questions(s, d), p, "qid", "q")


@query(
    "citation_list",
    """SELECT paper_id, coalesce(source, '') AS url, coalesce(nullif(section, ''), 'Unknown') AS citation, count(*) AS documents, arg_min(loaded_at, doc_id)::varchar AS date
 FROM documents GROUP BY ALL""",
)
def citation_list(s, d):
    hits = table(s, d, "documents").select("paper_id", F.col("source").alias("url"), F.col("section").alias("citation"), F.col("loaded_at").alias("date"), F.col("doc_id").alias("pos"))
    return evidence.citation_list(hits, "paper_id").withColumn("date", F.col("date").cast("string"))


@query(
    "ingest_outcomes",
    """SELECT count(*) AS attempted, count(*) FILTER (full_text <> '') AS success, count(*) FILTER (coalesce(full_text, '') = '' AND abstract <> '') AS skipped,
 count(*) FILTER (coalesce(full_text, '') = '' AND coalesce(abstract, '') = '') AS failed FROM papers""",
)
def ingest_outcomes(s, d):
    o = F.when(F.coalesce("full_text", F.lit("")) != "", "success").when(F.coalesce("abstract", F.lit("")) != "", "skipped").otherwise("failed")
    return evidence.outcomes(_papers(s, d).withColumn("outcome", o), "outcome", ["success", "skipped", "failed"])


_WF = " OR ".join(f"contains(lower(content), '{w}')" for w in questions.WORKFLOW_WORDS)


@query("workflow_questions", f"SELECT id, loaded_at, ({_WF}) AS seeks FROM messages WHERE content IS NOT NULL")
def workflow_questions(s, d):
    m = table(s, d, "messages").where("content IS NOT NULL")
    return m.select("id", "loaded_at", questions.seeks_workflow(F.col("content")).alias("seeks"))


@query("pdf_chain")
def pdf_chain(s, d):
    null = F.lit(None).cast("string")
    p = _papers(s, d).where("doi IS NOT NULL").select(F.col("paper_no").cast("string").alias("no"), "doi", "url", F.col("pdf_url").alias("oa_url"), null.alias("arxiv_id"), null.alias("unpaywall_pdf_url"))
    return services.pdf_chain(p)


@query(
    "citation_keys",
    r"""SELECT author_no, coalesce(nullif(family, ''), nullif(regexp_extract(trim(name), '([^ \t\n\x0B\f\r]+)$', 1), ''), 'Unknown') || coalesce("year"::varchar, 'n.d.') AS key
 FROM paper_authors JOIN papers USING (paper_no)""",
)
def citation_keys(s, d):
    both = table(s, d, "paper_authors").join(_papers(s, d).select("paper_no", "year"), "paper_no")
    return both.select("author_no", ids.citation_key(F.col("family"), F.col("name"), F.col("year")).alias("key"))


@query(
    "article_types",
    """SELECT paper_no FROM papers WHERE contains(lower(coalesce(title, '')), 'review') AND (contains(lower(concat_ws(' ', title, journal)), 'review')
 OR contains(lower(concat_ws(' ', title, journal)), 'survey'))""",
)
def article_types(s, d):
    return services.by_type(_papers(s, d), "review", "title", "title", "journal").select("paper_no")


@query("kb_pipeline")
def kb_pipeline(s, d):
    """Chunks with vectors of all searchable papers, as they are ingested."""
    p = _papers(s, d).select(
        F.col("paper_no").alias("paper_id"), "title", F.array_join(F.transform("authors", lambda a: a["name"]), ", ").alias("authors"), "year", "doi", "abstract", "full_text", "source"
    )
    return engine.built(p, connectors.HashingEmbedder(), 200, 40).select("paper_id", "chunk_index", "id", F.size("embedding").alias("dim"))


def _engine(s, d) -> engine.Engine:
    docs = spread(table(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("paper_id"), "text", "source"))
    chunks = chunking.word_windows(docs, "paper_id", "text", 200, 20).join(docs.select("paper_id", "source"), "paper_id")
    named = chunks.withColumn("id", ids.packed(F.col("paper_id"), F.col("chunk_index")))
    return engine.Engine(cut(connectors.embedded(named, "chunk", connectors.HashingEmbedder())), connectors.HashingEmbedder(), connectors.EchoModel())


def _mode(name: str):
    def run(s, d):
        q = _papers(s, d).where("paper_no % 100 = 0 AND title IS NOT NULL").select(F.col("paper_no").alias("qid"), F.col("title").alias("q"))
        out = _engine(s, d).query(name, q)
        return out.select("qid", "place", "paper_id", F.round("score", 6).alias("score"), F.length("full_text").alias("chars"))

    return run


for _name in ("basic", "advanced", "profound", "agentic", "survey"):
    QUERIES[f"mode_{_name}"] = _mode(_name)
