"""Training-data operators (quality, near duplicates, token counts, secrets,
sharding, packing, decontamination, URL filters, substring duplicates).

Nothing else in the library imports this subpackage. ``queries.py`` holds the
driver keys, ``corpus_pipeline.py`` at the repository top chains five of them.
"""
