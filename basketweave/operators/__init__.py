"""Operators: DataFrame in, DataFrame out, lazy, with explicit parameters and tie-breaks."""
