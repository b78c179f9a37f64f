"""Training-data operators: packing, search, quality, joins, PII, decontamination and more.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only where it can be imported.
"""
