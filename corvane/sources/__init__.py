"""Sources of pages, chunks and question sets."""
