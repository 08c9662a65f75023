"""Operators for preparing large text collections for language-model training.

Ten operators, one module each; ``queries.py`` holds the thin registered
queries and ``sql.py`` their DuckDB counterparts. Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
