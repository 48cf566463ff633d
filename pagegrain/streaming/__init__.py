"""The same row-wise jobs on files as they arrive."""
