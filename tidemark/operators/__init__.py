"""Operators: page rows to findings, periods, links and scores."""
