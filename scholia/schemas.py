"""Row types of the record families as DDL: papers, catalog rows, objects, regions and events."""

from __future__ import annotations

AUTHORS = "array<struct<name:string,affiliations:array<string>>>"

PAPERS = (
    f"id string, title string, authors {AUTHORS}, abstract_text string, publication_date date, doi string, "
    "download_urls array<string>, cited_by_count bigint, source string, rank int"
)

CATALOG = (
    "stem string, title string, doi string, downloaded_at string, file_size_bytes bigint, markdown_path string, "
    "conversion struct<converted_at:string,server:string,duration_secs:double,total_pages:bigint,failed:boolean,reason:string>, "
    "pages array<struct<page:int,char_start:int,char_end:int>>, "
    "embedding struct<embedded_at:string,server:string,chunks_indexed:bigint,compute_device:string>, "
    "embedding_skip struct<at:string,reason:string>, repair struct<at:string,reason:string>"
)

OBJECTS = "key string, size bigint, last_modified timestamp"

EVENT_LINE = "subject string, payload string, at timestamp"
INGESTED = "key string, sha256 string, size_bytes bigint, source string"
COMPLETED = "key string, source_key string, batch bigint"

REGIONS = "doc string, page int, x1 double, y1 double, x2 double, y2 double, confidence double, class_name string, read_order double, unique_id int"

PAGE_SEPARATOR = "\n\n---\n\n"
