"""DataFrame operators. Every relation that has an order carries it in a column; ties are broken by it."""
