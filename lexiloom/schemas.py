"""Row types of the engine's tables, as DDL that createDataFrame and readers take."""

CATALOG = "doc_id string, name string, description string, category string"
QRELS = "query string, doc_id string, grade int"
EVAL_QUERIES = "query string, family string, expected_patch_kinds array<string>, note string"
KNOWLEDGE = "doc_id string, title string, body string, source string, families array<string>"
QUERY_LOG = "ts date, query string, n_results int, clicked boolean"
VECTORS = "token string, vec array<double>"
METRICS = "query string, ndcg double, recall double, precision5 double, n_results int"
TOKEN = "struct<form:string,tag:string,origin:string>"
PATCH = "target_query string, diagnosis_family string, reasoning string, user_words array<struct<form:string,tag:string>>, synonym_groups array<array<string>>, compound_expansions array<struct<word:string,parts:array<string>>>"
STORED_PATCH = "session_id string, seq int, prescription string, evidence string, attempts int, created_at timestamp"
SESSION = "session_id string, target_query string, created_at timestamp"
EVIDENCE = "struct<target_ndcg:array<double>,target_results:array<int>,evalset_mean_ndcg:array<double>>"
LEDGER = f"no int, target_query string, diagnosis_family string, patch string, reasoning string, evidence {EVIDENCE}, attempts int"

#: What a failing query can suffer from.
FAMILIES = ("spelling_variant", "cross_script", "synonym_gap", "compound_locked", "garbage_split")
