"""The registered queries: the engine's operators over the given tables."""
