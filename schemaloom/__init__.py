"""Schema, constraint and lineage analytics over fleets of warehouse projects."""
