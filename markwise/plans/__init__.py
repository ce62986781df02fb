"""Whole queries: the operators over tables of a folder, with equivalent SQL, and the matching and preparation pipelines."""
