"""Spatial expression analytics as Spark DataFrame operators.

Every public function takes DataFrames and returns DataFrames; rows are tied
together by explicit keys, never by position.
"""
