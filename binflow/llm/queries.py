"""Loads every operator of the subpackage, which registers its query."""

from binflow.llm import audit, bpe, chat, codes, decontaminate, language, quality, secrets, simhash, spotsigs, tokens, urls, vafile  # noqa: F401
from binflow.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
