"""Fixed schemas of the library tables."""

PAPERS = (
    "id BIGINT, doi STRING, title STRING, authors ARRAY<STRING>, journal STRING, year INT, volume STRING, "
    "issue STRING, pages STRING, abstract STRING, keywords ARRAY<STRING>, tags ARRAY<STRING>, "
    "collection_ids ARRAY<BIGINT>, file_path STRING, date_added STRING, date_modified STRING, "
    "metadata_source STRING, needs_review BOOLEAN, open_access BOOLEAN, isbn STRING, document_type STRING"
)
PAPER_COLUMNS = [part.split()[0] for part in PAPERS.split(", ")]

COLLECTIONS = "id BIGINT, name STRING, parent_id BIGINT"

FULLTEXT = (
    "id BIGINT, page_texts ARRAY<STRING>, xmp_title STRING, xmp_author STRING, xmp_subject STRING, "
    "xmp_keywords STRING, file_name STRING"
)

#: Columns an edit log may set; anything else is an error.
EDITABLE = [c for c in PAPER_COLUMNS if c not in ("id", "date_added", "date_modified")]
