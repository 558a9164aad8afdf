"""The registered queries, one module per operator family."""

import importlib

MODULES = ["q_sequences", "q_motifs", "q_intervals", "q_atlas", "q_variants", "q_stats", "q_audit", "q_models", "q_heads"]


def load():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
