"""Operators that prepare text for training sets. Nothing outside this subpackage imports it."""
