"""From syntax trees to Catalyst plans."""
