"""DataFrame operators over panels, ordered events, trees, draws and lineages."""
