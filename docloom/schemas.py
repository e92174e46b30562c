"""Table schemas, as DDL strings: one place for the names and types of all tables."""

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SPANS = "array<struct<name:string,start_line:int,end_line:int>>"

REPORTS = "doc_id string, title string, source_path string"
TABLE_ROWS = "row_id string, doc_id string, row_no int, item string, code string, reason_kw_raw string, line_number int"
FINDINGS = f"finding_id string, doc_id string, item string, item_detail string, code string, reason_kw_norm array<string>, sections_present array<string>, section_spans {SPANS}, start_line int, end_line int"
ROW_FINDING_MAP = "map_id string, row_id string, finding_id string, score double, code_mismatch boolean, needs_review boolean"
CHUNKS = "chunk_id string, finding_id string, doc_id string, section string, section_order int, chunk_order int, code string, item string, item_norm string, page int, start_line int, end_line int, text string, text_norm string, text_raw string, meta_line string, extraction_version string, created_at timestamp"
LAW_REFERENCES = "law_id string, finding_id string, doc_id string, law_type string, law_name string, law_content string, page int, line_number int, bbox array<double>, law_order int, extraction_version string, created_at timestamp"
LAYOUT_ITEM = "struct<type:string,color:string,bbox:array<double>,path:string,content:string,law_type:string,law_name:string,law_content:string>"
LAYOUT_JSON = f"map<string,array<{LAYOUT_ITEM}>>"

KEYS = {"reports": "doc_id", "table_rows": "row_id", "findings": "finding_id", "row_finding_map": "map_id", "chunks": "chunk_id", "law_references": "law_id"}
VERSION = "v0.5.0"
