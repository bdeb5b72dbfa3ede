"""Readers: fetched pages, endpoint payloads, robots files, URL lists, CSV."""
