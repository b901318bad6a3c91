"""Column-level building blocks: mesh keys, geometry, numerics, legend rules, exact ranks."""
