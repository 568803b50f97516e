"""Registered queries over the supplied tables, each with its SQL twin where SQL can say it."""

from captrellis.queries import captions, corpus, images, samples, vectors

_MODULES = (captions, corpus, images, samples, vectors)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
