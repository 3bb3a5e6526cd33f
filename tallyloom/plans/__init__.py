"""Queries bound to the test tables; importing this package registers them."""

from tallyloom.plans import documents, inventory, profile, retrieval, sequences, state, text, vectors  # noqa: F401
