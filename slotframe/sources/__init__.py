"""Reading definitions and landed ledger records."""
