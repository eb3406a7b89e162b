"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Nothing outside this folder imports it. One module per operator, ``store`` and
``order`` hold what several of them share, ``queries`` registers them.
"""
