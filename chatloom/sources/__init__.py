"""Readers: tables, state and topic files, manifests, tagged JSON, paged history."""
