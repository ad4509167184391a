"""Operations of a training-data pipeline over tables of texts.

Every module holds one operator with a general interface; ``queries`` binds them
to the given tables and ``oracles`` holds the same results as SQL where SQL can
express them. Nothing outside this subpackage imports it.
"""
