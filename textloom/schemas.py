"""Explicit schemas of what stages hand over."""

PAGE = "struct<text: string, word_count: int, table_count: int, image_count: int, has_tables: boolean, has_images: boolean>"
TABLE = "struct<table_id: int, page: int, method: string, data: array<array<string>>, content: string, rows: int, cols: int, bbox: array<double>, confidence: string>"
IMAGE = "struct<image_id: int, page: int, method: string, xref: int, width: int, height: int, bbox: array<double>>"
QUALITY = (
    "struct<overall_quality: double, components: struct<lexical_diversity: double, readability: double, information_density: double, "
    "structural_complexity: double, content_richness: double>, methodology: string, word_count: int, sentence_count: int>"
)
EXTRACTED = (
    "file_path string, extraction_method string, extraction_success boolean, error string, "
    f"pages map<string, {PAGE}>, tables array<{TABLE}>, images array<{IMAGE}>, images_detected int, total_pages int, "
    f"metadata map<string, string>, quality_assessment {QUALITY}, "
    "document_stats struct<total_words: int, total_tables: int, total_images: int, total_pages: int>"
)
REJECTION = "ord long, filename string, stage string, reason string, word_count int"
DUP_PAIR = "type string, removed string, kept string, similarity double"
