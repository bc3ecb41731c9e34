"""Training-data operators.

Nothing else in the library imports this subpackage; its queries are in
``queries.py`` and its SQL twins in ``oracles.py``.
"""
