"""quarry: pattern, graph and sequence analytics as DataFrame plans."""
