"""Sources: the derived views over the driver's tables, captured packets, stored registries."""
