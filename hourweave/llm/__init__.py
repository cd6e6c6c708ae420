"""Operators for preparing language-model training text.

Nothing else in the library imports this subpackage; it may import the
library's general helpers. Every operator takes a DataFrame and column names,
ignores all other columns, and says in its docstring what nulls, empty texts,
ties and repeated rows mean for it.
"""
