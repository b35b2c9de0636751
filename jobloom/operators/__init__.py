"""DataFrame-to-DataFrame operators: cleaning, listing, state and roll-ups."""
