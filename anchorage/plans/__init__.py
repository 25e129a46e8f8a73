"""Whole runs: crawl, check and report, and the queries over the test tables."""
