"""agentscan: Spark jobs that scan text collections for agent-security problems and score them."""
