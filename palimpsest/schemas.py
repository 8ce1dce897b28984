"""Schemas of the history tables."""

EDGES = "repo string, child string, parent string, parent_ix int"
REFS = "repo string, name string, sha string, committer_time timestamp, tz_min int, is_default boolean"
COMMITS = (
    "repo string, sha string, author_name string, author_email string, committer_name string, committer_email string, "
    "date timestamp, date_tz_min int, ordinal bigint, message string, parents array<string>"
)
COMMIT_FILES = (
    "repo string, sha string, filename string, status string, renamed boolean, copied boolean, renamed_from string, "
    "renamed_to string, copied_from string, additions int, deletions int, binary boolean"
)
PATCHES = "repo string, sha string, seq bigint, diff_from string, change_ix int, diff binary"
BLAME = "repo string, sha string, path string, blame_commit string, is_binary boolean, lines array<struct<line:binary,commit:string>>"
BRANCHES = (
    "repo string, branch_id string, name string, is_pull_request boolean, head_sha string, is_default boolean, is_merged boolean, "
    "merge_commit string, branched_from_commits array<string>, commits array<string>, behind_default_count int, "
    "ahead_default_count int, first_commit string"
)
TREE = "repo string, sha string, path string"
EOF_MARK = b"\\ No newline at end of file"
