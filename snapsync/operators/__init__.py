"""Layout, chunks, bundles, resumption, verification and reports."""
