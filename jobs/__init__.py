"""Runnable jobs: each reads tables by path, runs the library's operators and writes partitioned tables."""
