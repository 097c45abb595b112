"""Training-data operators: scoring, dedup, filtering, mixing and retrieval over corpora.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
