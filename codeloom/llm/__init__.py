"""Operators for preparing large text corpora. Nothing else in codeloom imports this subpackage."""
