"""Row-local flows over files as they arrive."""
