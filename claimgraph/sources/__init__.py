"""Readers of the claim-store tables and written intermediate tables."""

from claimgraph.sources.tables import records, table
from claimgraph.sources.shared import shared_dir, stage

__all__ = ["records", "shared_dir", "stage", "table"]
