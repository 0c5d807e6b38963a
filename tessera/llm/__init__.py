"""Training-data operators (deduplication, filtering, scoring, tokenising, archives) as Spark jobs.

Nothing outside this subpackage imports it.  Each module holds one operator; ``queries``
registers the thin queries over the fixture tables.
"""
