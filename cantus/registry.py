"""Registered queries of the music-structure operators and their DuckDB SQL."""

from __future__ import annotations

from .plans import q_eval, q_lyrics, q_more, q_series, q_story

MODULES = [q_series, q_eval, q_lyrics, q_story, q_more]


def queries():
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
