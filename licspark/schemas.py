"""Schemas of the tables the operators exchange."""

RAW_FINDINGS = "seq long, path string, source string, licenses array<string>, text string"
FILES = (
    "kind string, path string, licenses array<string>, mapped_licenses array<string>, "
    "tags array<string>, file_type string, license_related_words array<string>, "
    "no_license_related_words array<string>, remove boolean, indirect boolean, text string"
)
CONTENTS = "path string, content string"
CSV_DUMP = "path string, conclusion string, scanner_result string, source string, file_id string, upload_id string"
LICENSE_MAPPING = "old string, new array<string>"
LICENSE_TEXTS = "license string, text string"
SEGMENT = "struct<seg_type:string,start_line:int,end_line:int,body:string>"
ANALYSIS = "metric string, key string, n long"
