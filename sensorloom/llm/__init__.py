"""Training-data operators: extraction, filtering, deduplication, mixing, packing and output.

Nothing else in the library imports this subpackage; ``queries`` and ``oracles`` hold what
``__spark_entry__.py`` registers.
"""
