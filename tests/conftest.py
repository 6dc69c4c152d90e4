import pytest

from paperlake import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
        "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false",
    }
    s = session.build("local[4]", **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


# The test tables' columns.
TABLES = {
    "papers": "paper_no long, id string, title string, authors array<struct<name:string,given:string,family:string,orcid:string>>, year int, doi string, "
    "abstract string, journal string, pmid string, url string, pdf_url string, full_text string, citation_count int, source string, keywords array<string>, "
    "metadata map<string,string>, loaded_at timestamp_ntz",
    "paper_authors": "author_no long, paper_no long, author_pos int, name string, given string, family string, orcid string",
    "search_records": "record_no long, title string, author string, date_text string, doi string, publication_title string, abstract_note string, url string, "
    "citation_count int, api_source string, loaded_at timestamp_ntz",
    "sessions": "id string, user_id string, created_at timestamp_ntz, preferences string, deleted_at timestamp_ntz, loaded_at timestamp_ntz",
    "conversations": "id string, session_id string, title string, kb_name string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, "
    "loaded_at timestamp_ntz",
    "messages": "id string, conversation_id string, role string, content string, sources string, metadata string, timestamp timestamp_ntz, loaded_at timestamp_ntz",
    "kb_metadata": "name string, description string, collection_name string, embedding_model string, chunk_config string, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, paper_count int, chunk_count int, deleted_at timestamp_ntz, loaded_at timestamp_ntz",
    "source_catalog": "source_name string, trust_rank int, mix_weight double, max_repeats int",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, paper_id string, section string, loaded_at timestamp_ntz",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def _written(spark, folder, fill: bool) -> str:
    from pyspark.sql import functions as F

    for name, schema in TABLES.items():
        none = spark.createDataFrame([], schema)
        # a row of nulls, twice, beside a column of a name that clashes with none of the schema's own uses
        rows = spark.range(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in none.schema], F.lit("x").alias("k"), F.lit(1).alias("rank")) if fill else none
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    """A folder with all tables and no rows."""
    return _written(spark, tmp_path_factory.mktemp("empty"), False)


@pytest.fixture(scope="session")
def null_tables(spark, tmp_path_factory):
    """A folder with two rows of nulls and two columns more in each table."""
    return _written(spark, tmp_path_factory.mktemp("nulls"), True)
