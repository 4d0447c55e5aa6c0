"""Operators over libraries of serial fiction, by the tables they read."""

from serialmill.operators import corpus, dialogue, lexicon, library, listening, nearest, pages, rules, speech, stores

MODULES = [library, corpus, listening, dialogue, pages, rules, speech, lexicon, stores, nearest]
