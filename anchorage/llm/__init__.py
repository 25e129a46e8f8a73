"""Operators for preparing training corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py`` beside the package)
imports it.  Executors must be able to import the package: ship it with
``--py-files`` or install it on the workers.
"""
