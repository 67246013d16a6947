"""Readers: folders of files, office formats, web pages, session logs, graph files."""
