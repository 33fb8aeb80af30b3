"""Plans: the whole path from grids to observations, and the catalogue of queries."""
