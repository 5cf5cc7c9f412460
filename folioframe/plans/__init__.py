"""Query plans over the shipped tables and the shared plan building blocks."""
