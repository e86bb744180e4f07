"""Training-data operators: tokenisation, scoring, deduplication, filtering and search over large corpora.

Nothing else in the package imports this subpackage; ``llm.registry`` lists its queries.
"""
