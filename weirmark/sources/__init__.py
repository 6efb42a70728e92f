"""Reading and writing: flow streams, dimension tables, fact and rollup tables."""
