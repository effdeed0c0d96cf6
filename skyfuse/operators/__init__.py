"""Operators on DataFrames: spatial joins, greedy selection and matching, fusion, votes, evaluation."""
