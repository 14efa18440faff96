"""Operators for preparing training data: ten methods and the pipeline that joins four of them."""
