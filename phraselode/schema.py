"""Schemas of a collection's two tables, declared once and never inferred."""

from __future__ import annotations

DOCUMENTS = "topic string, doc string, text string, lang string"
GOLD = "topic string, doc string, cluster int, variant_pos int, phrase string"
