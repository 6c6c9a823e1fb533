"""claimgraph: DataFrame operators over provenance-tracked claim stores."""
