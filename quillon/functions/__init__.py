"""Scalar semantics of the expression language as functions of Spark columns."""
