"""Operators for building language-model training data; nothing outside this subpackage imports it."""
