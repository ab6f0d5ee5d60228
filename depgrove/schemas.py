"""Table schemas as DDL and the enumerations of the data model."""

SCHEMA_VERSION = 7

DOCUMENTS = "doc_id string, path string, title string, content string, plain_text string, content_hash string, last_modified timestamp"
CHUNKS = "chunk_id string, doc_id string, heading_path string, start_line int, end_line int, content string, tokens array<string>, chunk_len int"
POSTINGS = "term string, chunk_id string, doc_id string, tf int"
NODES = "id string, type string, title string, component_type string, description string, tags array<string>"
SIGNAL = "struct<source_type: string, confidence: double, evidence: string, weight: double>"
EDGES = f"id string, src string, dst string, type string, confidence double, evidence string, source_file string, extraction_method string, source_type string, signals array<{SIGNAL}>"
MENTIONS = "component_id string, file_path string, heading_hierarchy string, detected_by string, confidence double"
ALIASES = "alias string, canonical_id string, normalized_by string, confidence double, created_at timestamp"
CODE_SIGNALS = "source_component string, target_component string, target_type string, signal_type string, confidence double, evidence string, file_path string, line_number int, language string"

# Fixed values of the data model.
EDGE_TYPES = ("references", "depends-on", "calls", "implements", "mentions", "related")
EXTRACTION_METHODS = ("explicit-link", "co-occurrence", "structural", "NER", "semantic", "LLM", "code-analysis")
SOURCE_TYPES = ("markdown", "code", "both")
COMPONENT_TYPES = (
    "service", "database", "cache", "queue", "message-broker", "load-balancer", "gateway", "storage", "container-registry",
    "config-server", "monitoring", "log-aggregator", "orchestrator", "secrets-manager", "search", "unknown",
)
TIERS = (("explicit", 0.95), ("strong-inference", 0.75), ("moderate", 0.55), ("weak", 0.45), ("semantic", 0.42), ("threshold", 0.40))
TIER_SCORES = {"explicit": 1.0, "strong-inference": 0.8, "moderate": 0.6, "weak": 0.5, "semantic": 0.45, "threshold": 0.4}
ALGORITHM_WEIGHTS = {"cooccurrence": 0.3, "ner": 0.5, "structural": 0.6, "semantic": 0.7, "code": 0.85, "llm": 1.0}
OTHER_ALGORITHM_WEIGHT = 0.5
