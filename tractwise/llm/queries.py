"""Collects the queries of every module of this subpackage, and the pipeline."""

import importlib

import corpus_pipeline

from .registry import ORACLES, QUERIES

MODULES = ["q_rules", "q_mix", "q_warc", "q_dups", "q_models", "q_audit"]

for _name in MODULES:
    importlib.import_module(f"{__package__}.{_name}")

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
