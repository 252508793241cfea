"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; it depends only on
Spark, numpy and pyarrow (and on the tokenizers library where tokens count).
"""
