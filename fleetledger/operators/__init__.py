"""Set-based operators, one module per subject."""
