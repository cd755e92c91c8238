"""Operators for training-data corpora, and their queries."""

from rollcall.llm import ann, chat, decontaminate, licenses, lines, minhash, packing, parity, pseudonyms, repair, token_counts, toxicity, whitening  # noqa: F401 - importing registers the queries
from rollcall.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
