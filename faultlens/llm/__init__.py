"""Operators for preparing training corpora (documents, pages, embeddings).

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries; each operator module keeps its own general interface.
"""
