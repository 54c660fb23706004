"""Lets pytest import the package from the repository's top."""
