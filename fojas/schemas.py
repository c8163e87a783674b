"""Row shapes of the tables stages exchange, as Spark DDL."""

PAGE_VERSION = "edition STRING, amendment STRING, date STRING"

PAGE_BLOCKS = (
    "content_hash STRING, pdf_page INT, page_height DOUBLE, block_no INT, block_type INT,"
    " x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, text STRING"
)
PAGE_LINES = (
    "content_hash STRING, pdf_page INT, block_no INT, line_no INT, x0 DOUBLE,"
    " bbox STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>, text STRING, flags INT,"
    " block_y0 DOUBLE, page_height DOUBLE, block_text STRING"
)
PAGE = "pdf_page: INT, printed_page: STRING, edition: STRING, amendment: STRING, date: STRING"
DOCUMENTS = (
    "answer_id STRING, document_index INT, part STRING, section STRING, title STRING, term STRING,"
    f" source_url STRING, pages ARRAY<STRUCT<{PAGE}>>,"
    f" refs ARRAY<STRUCT<to_part: STRING, {PAGE}, text: STRING>>"
)
RAW_CITATION = (
    "type: STRING, cited_text: STRING, document_index: INT, start_block_index: INT, end_block_index: INT"
)
TOKENS = (
    "input_tokens: BIGINT, output_tokens: BIGINT, cache_creation_input_tokens: BIGINT,"
    " cache_read_input_tokens: BIGINT"
)
RESPONSE = (
    "model STRING, stop_reason STRING,"
    f" content ARRAY<STRUCT<type: STRING, text: STRING, citations: ARRAY<STRUCT<{RAW_CITATION}>>>>,"
    f" usage STRUCT<{TOKENS}, iterations: ARRAY<STRUCT<type: STRING, model: STRING, {TOKENS}>>>"
)
RESPONSES = "answer_id STRING, raw STRING"

LISTING_CELLS = "sheet STRING, row_no INT, cells ARRAY<STRING>"
TREE_NODES = (
    "part STRING, content_hash STRING, node_id STRING, parent_id STRING, preorder INT,"
    " start_index INT, end_index INT, is_leaf BOOLEAN, title STRING"
)
SEARCH_EVENTS = "question_id STRING, part STRING, seq INT, type STRING, name STRING, arguments STRING"
SECTION_REF = "parte: STRING, seccion: STRING"
EVAL_CASES = (
    "id STRING, question STRING, expected ARRAY<STRUCT<part: STRING, section: STRING>>,"
    " reference_answer STRING, out_of_scope BOOLEAN, source STRING"
)
CANDIDATES = (
    "id STRING, parte STRING, seccion STRING, seccion_title STRING, seccion_text STRING,"
    " question STRING, reference_answer STRING, model STRING, status STRING"
)
PRICES = "model STRING, input DOUBLE, cache_write DOUBLE, cache_read DOUBLE, output DOUBLE"
ATTEMPTS = (
    "exchange_id STRING, stage STRING, seq BIGINT, model STRING, requests BIGINT, input_tokens BIGINT,"
    " cache_creation_input_tokens BIGINT, cache_read_input_tokens BIGINT, output_tokens BIGINT,"
    " metered BOOLEAN"
)
