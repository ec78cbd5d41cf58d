"""Dataflow operators over memories, links, projects and vectors."""
