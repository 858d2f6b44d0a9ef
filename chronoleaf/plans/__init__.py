"""All driver queries of the timeline engine, by name, and their DuckDB counterparts."""
