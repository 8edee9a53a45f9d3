"""Plans over whole tables: the batch API, the evaluators and the registered queries."""
