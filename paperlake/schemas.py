"""Schemas of the engine's tables; readers use them instead of inference."""

AUTHOR = "struct<name:string,given:string,family:string,orcid:string>"
PAPER = (
    f"id string, title string, authors array<{AUTHOR}>, abstract string, year int, journal string, doi string, pmid string, url string, "
    "pdf_url string, citation_count int, source string, keywords array<string>, full_text string, metadata map<string,string>"
)
CHUNK = (
    "id string, text string, paper_id string, chunk_index int, section string, page_number int, source string, title string, authors string, "
    "year int, doi string, url string, embedding array<float>"
)
HIT = "query_id long, id string, paper_id string, text string, score double, rank int, retrieval_method string"
ENTRY = "entry_type string, key string, fields map<string,string>"
DISCOVERY = (
    "doi string, title string, is_oa boolean, oa_url string, pmcid string, arxiv_id string, abstract string, authors array<string>, year int, "
    "unpaywall_pdf_url string"
)
CONTENT = "doi string, source string, content_type string, text string"
REFERENCE = "ord int, doi string, title string, journal string, year string, authors array<string>, text string"
EVENT = "seq int, event string, data string"
STEP = "id string, type string, description string, tool string, tool_input map<string,string>, depends_on array<string>, condition string"
# Sources a paper may have.
SOURCES = ["bibtex", "scilex", "web_search", "user_upload", "citation_follow"]
