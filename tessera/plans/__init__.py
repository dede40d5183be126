"""Queries over the driver tables; each module registers its own."""
