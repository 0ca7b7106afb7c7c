"""Operators of a training-data pipeline: token files, rules, packing, scores and near duplicates."""
