"""Operators that turn a document corpus into training data; nothing else in the library imports this subpackage."""
