"""Spark operators over mined web data: pages, records, entities, edges, frontiers and events."""
