"""Plan-level helpers: shared scratch tables, hot-key joins, ordered indexes, query and oracle catalogues."""
