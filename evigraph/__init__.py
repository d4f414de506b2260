"""Evidence graphs as DataFrames: versioned nodes and edges, retrieval, path expansion, reasoning and evaluation."""
