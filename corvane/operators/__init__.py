"""DataFrame operators: indexing, retrieval, fusion, context selection, answer contracts, evaluation, integrity."""
