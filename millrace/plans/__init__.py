"""Registered queries, by topic."""

from millrace.plans import cleaning, curation, entities, panels, regulatory, stats, temporal, texts, timelines, web

MODULES = [cleaning, panels, curation, timelines, temporal, regulatory, stats, texts, web, entities]
