"""Queries of the core by name, and their SQL forms."""

from . import conversation, dedup, evidence, files, identities, ledger, macros, markup, outputs, problems, recall, requests, rollups, sessions, texts, traces

MODULES = (problems, sessions, ledger, texts, evidence, identities, dedup, conversation, macros, recall, traces, rollups, outputs, files, markup, requests)
