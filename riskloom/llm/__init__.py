"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing", "quality", "fingerprints", "warc", "chat", "ngram_trie", "perplexity", "bpe", "pii", "simhash", "repeats", "collocations", "clustering")


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= import_module(f"{__name__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= import_module(f"{__name__}.{name}").SQL
    return out
