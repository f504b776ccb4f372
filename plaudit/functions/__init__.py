"""Row-level column expressions: no shuffle, no Python workers."""
