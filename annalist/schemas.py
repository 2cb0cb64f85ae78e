"""Column layouts of the records, as DDL."""

COMMIT = (
    "sha STRING, author_name STRING, author_email STRING, authored_at STRING, message STRING, "
    "file_paths ARRAY<STRING>, diff_text STRING, file_changes ARRAY<STRUCT<path: STRING, old_path: STRING, "
    "new_path: STRING, change_type: STRING, additions: INT, deletions: INT>>, "
    "stats STRUCT<files: INT, insertions: INT, deletions: INT>"
)
PULL_REQUEST = (
    "number INT, title STRING, body STRING, state STRING, author STRING, created_at STRING, updated_at STRING, "
    "closed_at STRING, merged_at STRING, merge_commit_sha STRING, labels ARRAY<STRING>, review_comments ARRAY<STRING>"
)
ISSUE = (
    "number INT, title STRING, body STRING, state STRING, author STRING, created_at STRING, updated_at STRING, "
    "closed_at STRING, labels ARRAY<STRING>, comments ARRAY<STRING>, pull_request STRING"
)
RELEASE = (
    "tag STRING, tag_name STRING, name STRING, body STRING, created_at STRING, published_at STRING, timestamp STRING"
)
CI_RUN = (
    "run_id BIGINT, name STRING, status STRING, conclusion STRING, created_at STRING, updated_at STRING, "
    "html_url STRING, event STRING, branch STRING, actor STRING"
)
PR_GRAPHQL = (
    "number INT, title STRING, body STRING, author STRING, created_at STRING, merged_at STRING, "
    "closing_issues ARRAY<STRING>"
)
LINK = (
    "link_id STRING, source_type STRING, source_id STRING, target_type STRING, target_id STRING, relation STRING"
)
DOCUMENT = "doc_type STRING, doc_id STRING, payload STRING"
EDGE = "source_type STRING, source_id STRING, target_type STRING, target_id STRING, relation STRING"
HUNK = (
    "STRUCT<file_path: STRING, old_path: STRING, new_path: STRING, old_start: INT, old_count: INT, new_start: INT, "
    "new_count: INT, header: STRING, lines: ARRAY<STRING>>"
)
CHUNK = (
    "text STRING, chunk_id STRING, doc_type STRING, doc_id STRING, timestamp TIMESTAMP, author STRING, "
    "module_tags ARRAY<STRING>, entity_tags ARRAY<STRING>, graph_node_id STRING, file_paths ARRAY<STRING>, "
    "repo STRING, chunk_index INT, total_chunks INT"
)
ENTITY = "canonical_name STRING, entity_type STRING, aliases ARRAY<STRING>, doc_ids ARRAY<STRING>, seq BIGINT"
QA_PAIR = "question STRING, answer STRING, context STRING, source_chunk_id STRING, qa_type STRING"
CHECKPOINT = (
    "repo STRING, last_commit_sha STRING, last_pr_updated_at STRING, last_issue_updated_at STRING, updated_at STRING"
)

#: Layout of each document type's payload, and the payload's key.
PAYLOADS = {
    "commit": (COMMIT, "sha"),
    "pr": (PULL_REQUEST, "number"),
    "issue": (ISSUE, "number"),
    "release": (RELEASE, "tag"),
    "cicd": (CI_RUN, "run_id"),
    "pr_graphql": (PR_GRAPHQL, "number"),
    "link": (LINK, "link_id"),
}
RELATIONS = frozenset("closes follow_up mentions merge_commit parent references".split())
MODES = ("direct", "memo", "blame", "risk")
