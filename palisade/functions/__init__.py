"""Character functions: transformers, remap tables and interval predicates."""
