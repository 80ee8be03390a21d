"""Evidence operators: one module per layer, then composite, report, quality, controls and sweep."""
